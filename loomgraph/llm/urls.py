"""Operator 5, URL filters by a bit-parallel wildcard automaton (multiword Shift-And).

Every rule is a glob over the canonical form ``.host NUL path``; ``*`` stands for any
bytes and ``?`` for one. The literals of all rules take one bit each, packed into 64-bit
words. For each byte one step moves all states of all rules together, for all URLs of a
batch at once::

    state = ((state << 1 | start) & match[byte]) | (state & loop)

``loop`` has the literals that a ``*`` follows. A host rule ``host/path`` becomes
``*.host NUL /path*``, which fits the host, its subdomains, and paths that begin so; the
NUL occurs once, so no rule can match across the host's end. The longest rule that
accepts wins (its host and path counted in characters; ties: block before allow). A URL
that no rule accepts is judged by ``globs`` over its canonical form (first one that
accepts), then by ``default``.

Nulls: a null URL, or one without ``://``, has an empty host and path and only ``globs``
and ``default`` judge it. A null id is kept, repeated rows are judged each for itself, an
empty table gives an empty result, a URL of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, as_bytes, texts

#: (rule, verdict): the rule's host and, from the first slash, its path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: Globs over the canonical form for what no rule fits: spam and advert hosts, trackers, sign-in, cart and search pages, files that are no pages.
GLOBS = (
    *((f"*.{h}*\0*", "block") for h in ("cheap-", "free-", "buy-", "ads.", "ad.", "adserver.", "track.", "tracker.", "tracking.", "pixel.")),
    *((f"*{h}*\0*", "block") for h in ("casino", "viagra", "-pills", "porn", "lottery")),
    *((f"*\0*/{d}/*", "block") for d in ("wp-admin", "cgi-bin", "cart", "checkout", "login", "signup", "search", "tag", "feed")),
    *((f"*\0*/{f}", "block") for f in ("login", "signup", "register", "search", "wp-login.php", "xmlrpc.php", "robots.txt", "sitemap*.xml")),
    *((f"*\0*.{e}", "block") for e in ("jpg", "jpeg", "png", "gif", "svg", "css", "js", "zip", "gz", "exe", "mp3", "mp4", "avi")),
)


class GlobAutomaton:
    """Shift-And over several globs; ``accepts`` tells for each text which globs fit."""

    def __init__(self, globs: list[bytes]):
        match, loop, begin, anywhere, final = [], [], [], [], []
        self.empty = []
        for glob in globs:
            literals, stars = [], set()
            for byte in glob:
                if byte == ord("*"):
                    stars.add(len(literals) - 1)
                else:
                    literals.append(byte)
            base = len(match)
            self.empty.append((not literals, -1 in stars))
            for i, byte in enumerate(literals):
                match.append(byte)
                loop.append(i in stars)
                begin.append(i == 0)
                anywhere.append(i == 0 and -1 in stars)
            final.append(base + len(literals) - 1 if literals else -1)
        self.words = max(1, -(-len(match) // 64))
        self.loop, self.anywhere, self.begin = (self._bits(np.flatnonzero(x)) for x in (loop, anywhere, begin))
        self.match = np.stack([self._bits([i for i, m in enumerate(match) if m in (byte, ord("?"))]) for byte in range(256)])
        self.heads = self._bits(np.flatnonzero(begin))
        self.final = final

    def _bits(self, positions) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for p in positions:
            out[p // 64] |= np.uint64(1) << np.uint64(p % 64)
        return out

    def accepts(self, strings: list[bytes]) -> np.ndarray:
        """Boolean matrix: text by glob."""
        n = len(strings)
        lengths = np.fromiter(map(len, strings), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        data = np.frombuffer(b"".join(strings), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        state = np.zeros((n, self.words), np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        for i in range(int(sizes[0]) if n else 0):
            live = int(np.searchsorted(-sizes, -i, "left"))  # texts longer than i come first
            s = state[:live]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            moved &= ~self.heads
            moved |= self.begin if i == 0 else self.anywhere
            state[:live] = (moved & self.match[data[starts[:live] + i]]) | (s & self.loop)
        out = np.zeros((n, len(self.final)), bool)
        for g, f in enumerate(self.final):
            bare, starred = self.empty[g]
            out[order, g] = (starred | (sizes == 0)) if bare else (state[:, f // 64] >> np.uint64(f % 64)) & one != 0
        return out


def host_rule(rule: str) -> bytes:
    """The glob of a ``host/path`` rule over the canonical form."""
    host, slash, path = rule.partition("/")
    return b"*." + host.encode().translate(LOWER) + b"\0" + (slash + path).encode() + b"*"


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """Host (A-Z lower-cased) and path."""
    _, found, rest = (url or b"").partition(b"://")
    if not found:
        return b"", b""
    end = next((i for i, c in enumerate(rest) if c in b"/?#"), len(rest))
    path = rest[end:]
    cut = min((i for i in (path.find(b"?"), path.find(b"#")) if i >= 0), default=len(path))
    return rest[:end].translate(LOWER), path[:cut]


class Judge:
    """Rules, then globs, then the default, as one automaton."""

    def __init__(self, rules: tuple[tuple[str, str], ...], globs: tuple[tuple[str, str], ...], default: str):
        ranked = sorted(rules, key=lambda r: (-len(r[0]), r[1] != "block"))
        self.automaton = GlobAutomaton([host_rule(r) for r, _ in ranked] + [g.encode() for g, _ in globs])
        self.names = np.array([r for r, _ in ranked] + [None] * (len(globs) + 1), object)
        self.verdicts = np.array([v for _, v in ranked] + [v for _, v in globs] + [default], object)

    def __call__(self, column: pa.Array) -> tuple[list[tuple[bytes, bytes]], np.ndarray]:
        """Host and path of each URL, and the number of what judges it."""
        parts = [split_url(u) for u in as_bytes(column)]
        canonical = [b"." + h.replace(b"\0", b"\1") + b"\0" + p.replace(b"\0", b"\1") for h, p in parts]
        fits = np.concatenate([self.automaton.accepts(canonical), np.ones((len(parts), 1), bool)], 1)
        return parts, fits.argmax(1)


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, globs: tuple[tuple[str, str], ...] = GLOBS, default: str = "allow") -> DataFrame:
    """Per row: page_id, host, path, rule (null if none accepts), verdict."""
    from pyspark.sql.pandas.types import to_arrow_schema

    judge = Judge(rules, globs, default)
    rows = texts(pages, page_id, url).toDF("page_id", "url")
    out = T.StructType([T.StructField("page_id", rows.schema[0].dataType), *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, which = judge(batch.column(1))
            columns = [batch.column(0), pa.array([h for h, _ in parts], pa.binary()).cast(pa.string()), pa.array([p for _, p in parts], pa.binary()).cast(pa.string()), pa.array(judge.names[which].tolist(), pa.string()), pa.array(judge.verdicts[which].tolist(), pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, out)


def allowed_pages(pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, globs: tuple[tuple[str, str], ...] = GLOBS, default: str = "allow") -> DataFrame:
    """The rows of ``pages`` with an allowed URL, each judged for itself in one scan; columns stay as they are."""
    judge, at = Judge(rules, globs, default), pages.columns.index(url)
    plain = pages.toDF(*[f"c{i}" for i in range(len(pages.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array((judge.verdicts[judge(batch.column(at))[1]] == "allow").tolist(), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*pages.columns)


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _like(glob: str) -> str:
    host, _, path = glob.replace("*", "%").replace("?", "_").partition("\0")
    return f"('.' || host) LIKE '{host}' AND path LIKE '{path}'"


_GLOBBED = "CASE " + " ".join(f"WHEN {_like(g)} THEN '{v}'" for g, v in GLOBS) + " ELSE 'allow' END"
OP5_SQL = f"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rule, rhost, rpath, v) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM p JOIN r
      ON ('.' || host) LIKE ('%.' || rhost) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, host, path, m.rule, coalesce(m.v, {_GLOBBED}) AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id
"""
