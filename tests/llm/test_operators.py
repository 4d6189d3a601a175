"""Corpus operators against brute force on a small fixture with nulls, repeats, ties and clashing names."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, jaccard, katz, language, licenses, lines, mixing, pages, spots, urls, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, h string"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "and", "Ärger", "été", "naïve"]
    texts = [None, "", "   ", "One", "one Two", "a\nb\n\na", "x " * 3000]
    passage = " ".join(rng.choices(vocabulary, k=70))
    for i in range(60):
        body = rng.choices(vocabulary, k=rng.randrange(1, 160))
        text = " ".join(body)
        if i % 4 == 0:
            text += "\nCommon LINE here\n" + " ".join(rng.choices(vocabulary, k=9))
        if i % 5 == 0:
            text += "\n" + passage
        texts.append(text)
    base = " ".join(rng.choices(vocabulary, k=120))
    for _ in range(30):
        w = base.split()
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [base, base, passage, passage + " more", "common line HERE"]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "ä", None][i % 4], 1, "x", "y") for i, t in enumerate(texts)]
    return rows + [rows[20], (None, base, "en", "a", 0, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_word_splitting_and_hashes():
    texts = ["", None, "Ab  c\n", "ab", "x" * 3_000_000 + " y", "Ärger ab C", " ", "c"]
    h, starts, ends, first = words.words_of(pa.array(texts))
    got = [h[i:j].tolist() for i, j in zip(first[:-1], first[1:], strict=True)]
    assert [len(g) for g in got] == [len(split(t)) for t in texts]
    by = {}
    for t, g in zip(texts, got, strict=True):
        for w, x in zip(split(t), g, strict=True):
            assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    alnum = words.words_of(pa.array(["a-b é_1", "Z"]), alnum=True)[3]
    assert alnum.tolist() == [0, 4, 5]


def test_buckets_fill_partitions_evenly(spark):
    from loomgraph.llm import common

    values = np.array([0, 1, 7, 123456, 2**31 - 1])
    assert common.spark_hash(values).tolist() == [r[0] for r in spark.createDataFrame([(int(v),) for v in values], "v int").select(F.hash("v")).collect()]
    df = spark.range(64).select((F.col("id") % 16).cast("int").alias("bucket"))
    sizes = common.by_bucket(df, 16).applyInPandas(lambda t: t.assign(p=__import__("pyspark").TaskContext.get().partitionId())[["bucket", "p"]], "bucket int, p int").distinct().collect()
    assert sorted(r.p for r in sizes) == list(range(16)) and len({r.bucket for r in sizes}) == 16


@pytest.mark.parametrize("hot", [4, 0, 10**9])
def test_katz_scores_and_normalisation(monkeypatch, hot, docs, rows, empty):
    monkeypatch.setattr(katz, "HOT", hot)  # no context, some, and all contexts spread
    train, held = [], []
    for r in rows:
        out = zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 == 2
        (held if out else train).append([*split(r[1]), ""])
    tokens = collections.Counter(t for x in train for t in x)
    pairs = collections.Counter(p for x in train for p in zip(["\n", *x[:-1]], x, strict=True))
    n, v = sum(tokens.values()), len(tokens)
    one = katz.Unigrams([n, v, *[sum(c == r for c in tokens.values()) for r in range(1, katz.CUTOFF + 2)]])
    d2 = katz.discounts([sum(c == r for c in pairs.values()) for r in range(1, katz.CUTOFF + 2)])
    p1 = lambda w: float(one.p(np.array([tokens[w]]))[0])
    cut = lambda c: (d2[c - 1] if c <= katz.CUTOFF else 1.0) * c
    after = collections.defaultdict(dict)
    for (a, b), c in pairs.items():
        after[a][b] = c

    def p2(a, b):
        seen = after.get(a)
        if not seen:
            return p1(b)
        total, kept = sum(seen.values()), sum(map(cut, seen.values()))
        left = (total - kept) / total
        size = total + 1 if left <= 1e-12 else total
        left = 1 / size if left <= 1e-12 else left
        if b in seen:
            return cut(seen[b]) / size
        return left * p1(b) / (1 - sum(p1(w) for w in seen))

    for a in list(after)[:40]:  # each context's distribution sums to one over vocabulary and unknown event
        assert sum(p2(a, w) for w in tokens) + p2(a, "never seen") == pytest.approx(1, abs=1e-9)
    got = katz.score_texts(docs, block_tokens=2000).collect()
    assert len(got) == len(rows)
    expect = collections.defaultdict(list)
    for r in rows:
        x = [*split(r[1]), ""]
        expect[r[0]].append((len(x), sum(tokens[t] > 0 for t in x), sum(math.log10((tokens[t] + 1) / (n + v + 1)) for t in x), sum(math.log10(p2(a, b)) for a, b in zip(["\n", *x[:-1]], x, strict=True))))
    found = collections.defaultdict(list)
    for g in got:
        assert g.train_tokens == n
        assert g.held_out == (zlib.crc32(str(g.doc_id if g.doc_id is not None else "").encode()) % 7 == 2)
        found[g.doc_id].append((g.n_tokens, g.n_known, g.base_score, g.score))
    for k, x in expect.items():
        assert np.allclose(sorted(found[k]), sorted(x), rtol=1e-9)
    assert katz.score_texts(empty).count() == 0


def test_line_dedup(docs, rows, empty):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOW)
    df = collections.Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    expect = sorted((str(r[0]), len((r[1] or "").split("\n")), sum(df[key(x)] >= 5 for x in (r[1] or "").split("\n")), "\n".join(x for x in (r[1] or "").split("\n") if df[key(x)] < 5)) for r in rows)
    got = lines.drop_common_lines(docs, min_texts=5)
    assert sorted((str(g[0]), g.n_lines, g.n_dropped, g[1]) for g in got.collect()) == expect
    assert any(e[2] for e in expect)
    kept = lines.without_common_lines(docs, min_texts=5)
    assert kept.columns == docs.columns and kept.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert lines.without_common_lines(empty).count() == 0


def test_line_runs_level_up(spark):
    runs = lines.LineRuns(spark, min_texts=3, fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(i, f"same\nown {i}")], "doc_id long, text string"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    out = runs.filter(spark.createDataFrame([(9, "SAME \nown 1\nnew")], "doc_id long, text string")).collect()
    assert [r.text for r in out] == ["own 1\nnew"]


def test_line_runs_go_on_after_a_restart(spark, tmp_path):
    folder, make = f"file://{tmp_path}/runs", lambda i: spark.createDataFrame([(i, f"same\nown {i}")], "doc_id long, text string")
    for i in range(5):  # a new object per batch, as after a lost driver
        lines.LineRuns(spark, min_texts=3, fanout=2, folder=folder).add(make(i))
    runs = lines.LineRuns(spark, min_texts=3, fanout=2, folder=folder)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    (tmp_path / "runs" / "manifest-99").mkdir()  # a manifest that was never finished
    again = lines.LineRuns(spark, min_texts=3, fanout=2, folder=folder)
    assert again.levels == runs.levels
    batch = spark.createDataFrame([(9, "SAME \nown 1\nnew")], "doc_id long, text string")
    first, second = again.filter(batch), again.filter(batch.limit(0))
    assert [r.text for r in first.collect()] == ["own 1\nnew"] and second.count() == 0
    kept = {p.name for p in (tmp_path / "runs").iterdir() if p.name.startswith("run-")}
    assert kept == {run for level in again.levels for run in level}


def test_merging_sorted_runs():
    rng = np.random.default_rng(8)
    for _ in range(50):
        made = []
        for _ in range(2):
            n = int(rng.integers(0, 30))
            keys = np.unique(rng.integers(0, 5, (n, 2)).astype(np.uint64), axis=0).reshape(-1, 2)
            made.append((keys[:, 0], keys[:, 1], rng.integers(1, 9, len(keys))))
        if not sum(len(m[0]) for m in made):
            continue
        want = collections.Counter()
        for h, v, n in made:
            for key in zip(h.tolist(), v.tolist(), n.tolist(), strict=True):
                want[key[:2]] += key[2]
        got = lines.merge_sorted(*made)
        assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == sorted(want)
        assert dict(zip(zip(got[0].tolist(), got[1].tolist(), strict=True), got[2].tolist(), strict=True)) == want


def pairs_of(rows, threshold=70):
    sets = []
    for r in rows:
        w = split(r[1])
        sets.append(frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
    return sets, links


@pytest.mark.parametrize("hot,tile,threshold", [(8, 512, 70), (1, 4, 70), (2, 8, 50)])
def test_jaccard_groups(monkeypatch, docs, rows, hot, tile, threshold):
    monkeypatch.setattr(jaccard, "TILE", tile)
    sets, links = pairs_of(rows, threshold)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = collections.Counter()
    for i, j in links:
        n[i] += 1
        n[j] += 1
        parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    expect = sorted((str(r[0]), len(sets[i]), n[i], str(least.get(find(i)))) for i, r in enumerate(rows))
    got = jaccard.similar_groups(docs, threshold=threshold, hot=hot, piece=20_000).collect()
    assert sorted((str(g.doc_id), g.n_shingles, g.n_similar, str(g.component_id)) for g in got) == expect
    assert len(links) > 100


@pytest.mark.parametrize("tile", [512, 4])
def test_jaccard_truncated_copies_of_a_text_with_hot_keys(monkeypatch, spark, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = random.Random(7)
    long = [[f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 400))] for _ in range(40)]
    found = [" ".join(t) for _ in range(12) for t in long] + [" ".join(t[: int(len(t) * share)]) for share in (0.9, 0.84, 0.8, 0.75, 0.72) for t in long]
    rows = list(enumerate(found))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    want = collections.Counter(i for pair in pairs_of(rows)[1] for i in pair)
    got = {r.doc_id: r.n_similar for r in jaccard.similar_groups(df, piece=20_000).collect()}
    assert got == {i: want[i] for i, _ in rows}


@pytest.mark.parametrize("hot", [1, 8])
def test_jaccard_at_the_ends_of_bands(spark, hot):
    """Contained texts and clusters with sizes on both sides of every band's end; a text whose larger partners are all weak."""
    found = []

    def add(core, tails):
        """Texts with a common core of shingles and tails of their own."""
        head = [f"c{len(found)}x{i}" for i in range(core + 2)]
        found.append(" ".join(head))
        found.extend(" ".join([*head, *[f"t{len(found)}x{k}x{i}" for i in range(t)]]) for k, t in enumerate(tails))

    add(482, [168] * 15)
    add(482, [145] * 9)
    for end in [int(x) for x in jaccard.Bands(70).ends if 12 <= x <= 1500]:
        for total in (end - 1, end, end + 1):
            small = total * 41 // 100
            add(small, [total - 2 * small])
            add(small, [total - 2 * small] * 4)
            add(total // 2, [total % 2, 1, 2, 0])
    rows = list(enumerate(found))
    random.Random(1).shuffle(rows)
    sets = {i: set(zip(*[t.split()[k:] for k in range(3)], strict=False)) for i, t in rows}
    # Only texts of one core share shingles.
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t.split()[0]].append(i)
    want = collections.Counter({i: 0 for i in sets})
    for some in groups.values():
        for i in some:
            want[i] = sum(i != j and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j]) for j in some)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.n_similar for r in jaccard.similar_groups(df, hot=hot, piece=60_000).collect()}
    assert {i: (got[i], want[i]) for i in got if got[i] != want[i]} == {}
    assert sum(want.values()) > 300


@pytest.mark.parametrize("sample", [1, 8])
def test_jaccard_near_copies_meet_about_once(monkeypatch, spark, sample):
    """Many near copies of one text and a passage that unlike texts share: few more meetings than pairs that link, and no link lost."""
    monkeypatch.setattr(jaccard, "SAMPLE", sample, raising=False)
    met = []
    write = jaccard.Workspace.write

    def counted(self, df, table, *partition_by):
        out = write(self, df, table, *partition_by)
        if table == "heads":
            met.append(sum(r["count"] * (r["count"] - 1) // 2 for r in out.groupBy("shingle").count().collect()))
        return out

    monkeypatch.setattr(jaccard.Workspace, "write", counted)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    rows = []
    for _ in range(240):
        copy = list(base)
        for i in rng.sample(range(150), rng.randrange(1, 7)):
            copy[i] = word()
        rows.append(" ".join(copy))
        rows.append(" ".join([word() for _ in range(80)] + passage))
    rows = list(enumerate(rows))
    want = collections.Counter(i for pair in pairs_of(rows)[1] for i in pair)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_similar for r in jaccard.similar_groups(df, piece=60_000).collect()}
    assert got == {i: want[i] for i, _ in rows}
    assert sum(want.values()) > 20_000
    assert 0 < met[0] < 4 * sum(want.values()) // 2


def test_jaccard_edge_cases(spark, docs, empty):
    assert jaccard.similar_groups(empty).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert None in ids and 0 in ids and len(ids) < docs.count()


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(1)
    bands = jaccard.Bands(70)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 48, 300, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 48, 20, dtype=np.uint64)]))
        band = int(bands.of(np.array([len(a) + len(b)]))[0])
        bits = [jaccard._parity(s, np.array([0, len(s)]), 0, int(bands.words[band])).view(np.uint64) for s in (a, b)]
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(a, b))


def test_decontamination(spark, docs, rows, empty):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    items = [(1, " ".join(split(rows[-5][1])[5:40])), (2, "w1 w2"), (3, None), (4, ""), (12, "One"), (2, "w1 w2"), (None, "w3"), (30, rows[30][1]), (None, "One two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word(t)
        m = min(10, len(w))
        if w:
            for k in range(len(w) - m + 1):
                windows[tuple(w[k : k + m])] |= {str(i)} - {"None"}
    expect = []
    for r in rows:
        w, hit, found = word(r[1]), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                got = windows.get(tuple(w[k : k + m]))
                if got is not None:
                    hit |= set(range(k, k + m))
                    found |= got
        expect.append((str(r[0]), len(w), len(hit), sorted(found)))
    for limit in (10_000, 40):  # one set of automata, and several
        got = decontaminate.contaminated_words(docs, bench, part_windows=limit).collect()
        assert sorted((str(g[0]), g.n_words, g.n_hit, list(g["items"])) for g in got) == sorted(expect)
    assert sum(e[2] > 0 for e in expect) > 3
    assert decontaminate.contaminated_words(empty, bench).count() == 0
    assert decontaminate.contaminated_words(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.clean_rows(docs, bench).columns == docs.columns


def test_wu_manber_on_random_words():
    rng = np.random.default_rng(4)
    for m in (1, 2, 3, 10):
        text = rng.integers(0, 4, 6000)
        windows = np.unique(np.stack([text[i : i + m] for i in rng.integers(0, 5900, 30)]), axis=0)
        a = decontaminate.Automaton(windows, 5)
        first = np.array([0, 0, 2500, 2503, 6000])
        at, which = a.search(lambda p: text[p], first)
        expect = {(i, w) for lo, hi in zip(first[:-1], first[1:], strict=True) for i in range(lo, hi - m + 1) for w in range(len(windows)) if (text[i : i + m] == windows[w]).all()}
        assert set(zip(at.tolist(), which.tolist(), strict=True)) == expect


def test_html_extraction(spark):
    tpl = '<div class="promo"><p>Buy now</p></div>'
    page = lambda i, body: f'<html><head><title>t</title></head><body><nav><a>Home</a></nav><header>Site</header>{tpl}<article><h1>T &amp; {i}</h1>{body}<section class="comments"><p>nice!</p></section></article><aside>side</aside><form>f</form><footer>foot</footer><script>x="</p>"</script></body></html>'
    data = [(i, f"http://Site.org/{i}", page(i, f"<p>One\n two<br>x{i}<p><b>un</p>closed &eacute;<!-- no --><p>shared text</p>")) for i in range(8)]
    data += [(100, "http://b.org/", "<p>plain <i>text</i></p><ul><li>a<li>b</ul>"), (101, None, None), (102, "http://b.org/x", ""), (None, "http://b.org/y", "<div>x<")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    expect = {i: f"T & {i}\nOne two x{i}\nun\nclosed é\nshared text" for i in range(8)} | {100: "plain text\na\nb", 101: "", 102: "", None: "x<"}
    for limit in (1000, 0):
        got = {r.page_id: (r.text, r.n_chars) for r in pages.extract_pages(df, max_broadcast=limit).collect()}
        assert got == {k: (v, len(v)) for k, v in expect.items()}
    assert pages.extract_pages(df.limit(0)).count() == 0


def test_html_templates_are_removed_by_recurrence(spark):
    page = lambda i: f"<body><div><span>Same everywhere</span></div><div><p>own text {i}</p></div></body>"
    df = spark.createDataFrame([(i, "http://h.org/", page(i)) for i in range(6)], "page_id long, url string, html string")
    assert sorted(r.text for r in pages.extract_pages(df).collect()) == [f"own text {i}" for i in range(6)]


def test_html_templates_of_large_hosts_and_republished_pages(spark):
    page = lambda i: f"<body>{'<div>Section</div>' if i < 6 else ''}<div><p>own text {i}</p></div></body>"
    copy = "<body><div><div>republished</div></div></body>"
    data = [(i, "http://h.org/", page(i)) for i in range(100)] + [(100 + i, f"http://c.org/{i}", copy) for i in range(6)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    expect = {i: f"own text {i}" for i in range(100)} | {100 + i: "republished" for i in range(6)}
    for limit in (1000, 0):
        assert {r.page_id: r.text for r in pages.extract_pages(df, max_broadcast=limit).collect()} == expect


def test_html_recurring_containers_of_an_article_go(spark):
    page = lambda i: f"<body><article><h1>Title {i}</h1><p>shared words</p><section><b>About this site</b> and its people</section><p>own text {i}</p></article></body>"
    df = spark.createDataFrame([(i, "http://h.org/", page(i)) for i in range(6)], "page_id long, url string, html string")
    for limit in (1000, 0):
        got = pages.extract_pages(df, max_broadcast=limit, group_bytes=200)
        assert sorted(r.text for r in got.collect()) == [f"Title {i}\nshared words\nown text {i}" for i in range(6)]


def test_html_parser_is_linear():
    n = 400_000
    odd = ["<a" * (n // 2), "<a '" * (n // 4), "<a \"x> '" * (n // 8) + "'", "<a \"' >" * (n // 7), "<div>" * (n // 10) + "</p>" * (n // 8), "<ul><li>" + "<i>" * (n // 6) + "<li></li>" * (n // 18), "<!--" * (n // 4), "<a href" + " " * n + ">x", "<script>" * (n // 8)]
    for page in odd:
        began = time.process_time()
        root = pages.parse(page)
        pages.hash_subtrees(root, set())
        pages.main_text(root, set())
        assert time.process_time() - began < 8, page[:20]
    assert pages.main_text(pages.parse("<p>a < b and <i title='x>y'>c</i> <b title='open>d</b><p>e"), set()) == "a < b and c d\ne"


def test_html_teasers_and_comments_are_not_the_main_text():
    def text(page):
        return pages.main_text(pages.parse(page), set())

    teaser = "<article><h2>Other</h2><p>teaser</p></article>"
    assert text(f"<body><aside>{teaser}</aside><nav>{teaser}</nav><main><p>real</p></main></body>") == "real"
    assert text(f"<body><div class='related'>{teaser}</div><div><p>real</p></div></body>") == "real"
    assert text("<body><main><p>real</p></main><article class='comment'><p>nice</p></article></body>") == "real"
    assert text("<body><p>lead</p><article><p>real</p><article><p>nice</p></article>end</article><p>after</p></body>") == "lead\nreal\nend\nafter"
    assert text("<body><article><article><p>one</p></article><article><p>two</p></article></article></body>") == "one\ntwo"
    assert text("<body><div class='with-sidebar'><article class='post'><p>real</p></article></div></body>") == "real"


def test_globs_against_regular_expressions():
    rng = random.Random(2)
    globs = ["*", "", "a*", "*a", "a?b*c", "*ab*ba*", "a" * 70 + "*b", "??", "*a*b*a*b*"]
    texts = ["".join(rng.choices("abc", k=rng.randrange(0, 12))) for _ in range(300)] + ["a" * 70 + "ccb", ""]
    fits = urls.GlobAutomaton([g.encode() for g in globs]).accepts([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            rx = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g)
            assert fits[i, j] == bool(re.fullmatch(rx, t)), (t, g)


def test_url_filter(spark):
    cases = {"http://example.org/es/a?b": ("example.org/es/", "block"), "http://a.EXAMPLE.org/en/12#x": ("example.org/en/1", "block"), "https://x.org/": ("org/", "allow"), "http://notexample.org/es/": ("org/", "allow"), "http://a.com/fr/x": ("com/fr/", "allow"), "http://com/de/": ("com/de/", "block"), "http://a.com/x/.example.org/es/": (None, "allow"), "http://a.org": (None, "allow"), "no scheme": (None, "allow"), None: (None, "allow"), "": (None, "allow"), "http://a.net/example.org/es/": (None, "allow")}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    assert got == dict(enumerate(cases.values()))
    odd = urls.judge_urls(df, globs=(("*.net\0*", "block"),)).where("verdict = 'block' and rule is null")
    assert odd.count() == 1
    more = {"http://x.net/a.JPG": "allow", "http://x.net/a.jpg": "block", "http://x.net/a/login": "block", "http://www.cheap-pills.net/x": "block", "http://ads.x.net/": "block", "http://roads.x.net/": "allow", "http://x.org/login": "allow", "http://x.net/sitemap2.xml": "block", "http://x.net/?/login": "allow"}
    rows = [(i % 3 or None, u, "k") for i, u in enumerate([*more, *more])]
    wide = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    kept = urls.allowed_pages(wide)
    assert kept.columns == wide.columns
    assert sorted(r.url for r in kept.collect()) == sorted(2 * [u for u, v in more.items() if v == "allow"])
    assert urls.allowed_pages(wide.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, globs=(("*", "block"),)).where("rule is null").collect()} == {"block"}
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_language_identification(spark, empty):
    rng = random.Random(1)
    syllables = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti to it".split(), "de": "en er ch ie sch ei un au be ge te ver äu ß öl zu".split(), "fr": "le ré é en eau ou qui tion que ai è ê ç ux men".split()}
    make = lambda k: " ".join("".join(rng.choices(syllables[k], k=rng.randrange(1, 4))) for _ in range(rng.randrange(6, 60)))
    data = [(i, make(k), k) for i, k in enumerate(rng.choices(list(syllables), k=400))]
    data += [(1000, None, "en"), (1001, "123 !!", "de"), (1002, "", None), (1003, make("fr"), None), (None, make("de"), "de"), (1004, "Ω" * 5, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = language.identify(df).select(F.col("c0").alias("doc_id"), "held_out", "lang_pred", "score").collect()
    by = {r.doc_id: r for r in got}
    right = [by[i].lang_pred == k for i, t, k in data[:400] if by[i].held_out]
    assert len(right) > 40 and np.mean(right) > 0.97
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "fr"] and by[1000].score == 0
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(data)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in got)
    assert language.identify(df.limit(0)).count() == 0
    blank = language.identify(df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in blank] == ["und"]


def test_string_kernel_equals_its_definition():
    texts = ["Hello world", "hello there", "xyz", "été, né", ""]
    data, offsets = words.buffer_of(pa.array(texts))
    sets = []
    for i in range(len(texts)):
        d, o = words.buffer_of(pa.array([texts[i]]))
        sets.append(np.unique(np.concatenate([c[use] for c, use in language.ngram_codes(d, o)] or [np.zeros(0, np.int64)])))
    model = language.Model(["a"], np.unique(np.concatenate(sets)), np.ones((len(np.unique(np.concatenate(sets))), 1), np.float32))
    got, known = model.scores(data, offsets)
    assert np.allclose(got[:, 0], [math.sqrt(len(s)) for s in sets], rtol=1e-5)
    assert known.tolist() == [1, 1, 1, 1, 0]
    model = language.Model(["a"], sets[0], np.ones((len(sets[0]), 1), np.float32))
    assert np.allclose(model.scores(data, offsets)[1], [np.isin(s, sets[0]).mean() if len(s) else 0 for s in sets])


def test_kernel_regression_equals_the_dense_solution(monkeypatch):
    monkeypatch.setattr(language, "SLICE", 7)
    rng = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([rng.integers(k * 20, k * 20 + 40, 15), rng.integers(0, 90, 5)])) for k in (0, 1, 2) for _ in range(9)]
    truth, marks = np.repeat([0, 1, 2], 9), [s for i, s in enumerate(sets) if i % 9 < 4]
    model = language.fit_kernel(["a", "b", "c"], marks, sets, truth)
    codes = np.unique(np.concatenate(marks))
    dense = lambda some: np.array([np.isin(codes, s) / np.sqrt(max(1, np.isin(codes, s).sum())) for s in some])
    m, r = dense(marks), dense(sets)
    values, vectors = np.linalg.eigh(m @ m.T)
    good = values > 1e-6 * values.max()
    phi = np.concatenate([r @ m.T @ vectors[:, good] / np.sqrt(values[good]), np.ones((len(sets), 1))], 1)
    penalty = np.diag([0.1 / 9] * int(good.sum()) + [0]) * 9 * 3 / len(sets)
    beta = np.linalg.solve(phi.T @ phi / 9 + penalty, phi.T @ np.where(truth[:, None] == np.arange(3), 1.0, -1.0) / 9)
    assert np.allclose(r @ model.weights + model.shift, phi @ beta, atol=1e-3)


def test_language_stage_rejects_junk_and_keeps_short_texts(spark):
    rng = random.Random(4)
    kinds = {f"l{k:02}": ["".join(rng.choices("aeioubcdfghklmnprstvwz", k=rng.randrange(2, 4))) for _ in range(14)] for k in range(24)}
    make = lambda k, n: " ".join("".join(rng.choices(kinds[k], k=rng.randrange(1, 4))) for _ in range(n))
    data = [(i, make(k, rng.randrange(20, 60)), k) for i, k in enumerate(sorted(kinds) * 30)]
    data += [(5000 + i, make(k, 3), k) for i, k in enumerate(kinds)] + [(9000, "q0x jq7 xqj " * 9, None), (9001, "Ωψ" * 30, None), (9002, None, "l01"), (9003, "...", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("c0", F.lit("x")).withColumn("score", F.lit("y"))
    rows = language.identify(df).collect()
    right = [r.lang_pred == r.c2 for r in rows if r.c0 < 5000 and r.held_out]
    assert np.mean(right) > 0.95 and len({r.lang_pred for r in rows}) > 20
    kept = language.with_language(df)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {i for i, _, _ in data if i < 9000}
    blank = df.withColumn("text", F.lit(None).cast("string"))
    assert language.identify(blank).where("lang_pred = 'und' and not familiar").count() == len(data) and language.with_language(blank).count() == 0


def spot_sets(text):
    w = split(text)
    out = set()
    for i, x in enumerate(w):
        if x in spots.ANCHORS:
            tail = [y for y in w[i + 1 :] if y not in spots.ANCHORS][:2]
            if len(tail) == 2:
                out.add((x, *tail))
    return out


def test_spot_signatures(spark, docs, rows, empty):
    order = sorted([r for r in rows if r[0] is not None], key=lambda r: r[0])
    ids = [r[0] for r in order]
    got = {r.doc_id: r for r in spots.compare_next(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    seen = {r[0]: r[1] or "" for r in order}
    ids = sorted(seen)
    for k, i in enumerate(ids):
        t, following = seen[i], seen[ids[(k + 1) % len(ids)]]
        q = len(t) // 4
        e = t[: len(t) - q] + following[:q]
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[i].n_chars == len(t)
        a, b, c = spot_sets(t), spot_sets(e), spot_sets(following)
        if a and b:
            assert got[i].near_edited == pytest.approx(len(a & b) / len(a | b))
        if a and c:
            assert got[i].near_next == pytest.approx(len(a & c) / len(a | c))
    assert spots.compare_next(docs).count() == len(rows)
    assert spots.compare_next(empty).count() == 0
    alone = spots.compare_next(spark.createDataFrame([(1, "the red house")], "doc_id long, text string")).collect()
    assert alone[0].near_next == 1.0


def test_similar_spots(docs, rows):
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in spots.similar_spots(docs, 0.4).collect()}
    members = {}
    for r in spots.fingerprint_members(docs).collect():
        if r.spots:
            members[r.fp] = set(r.spots)
    expect = {(min(a, b), max(a, b)) for a in members for b in members if a != b and len(members[a] & members[b]) >= 0.4 * len(members[a] | members[b])}
    assert found == expect and expect


def test_license_scan(spark, empty):
    own = [f"the story goes on and on with words of number {i} and the version we know" for i in range(60)]
    marks = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC"}
    data = [(i, t) for i, t in enumerate(own)] + [(100 + i, f"{own[i]}\n{m}\n{own[i + 1]}") for i, m in enumerate(marks)] + [(200, None), (201, ""), (None, "All rights reserved.")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[100 + i].families for i in range(4)] == list(marks.values())
    assert all(got[i].families == "" and got[i].license == "none" for i in range(60))
    assert got[None].license == "unknown" and got[200].n_paragraphs == 0 and got[100].n_paragraphs == 3
    assert licenses.scan_licenses(empty).count() == 0


def test_license_paragraphs_that_are_no_templates(spark):
    wrapped = "Redistributions of source code must retain the above copyright\nnotice, this list of conditions and the following disclaimer."
    marks = {
        "Distributed under the terms of the MIT License, see LICENSE.txt": "MIT",
        "The code in this folder is released under the MIT License (c) 2020 Somebody": "MIT",
        'The Software is provided "as is", without warranty of any kind, express or implied': "MIT",
        "Neither the name of the author nor the names of its contributors may be used to endorse products derived from this software": "BSD",
        wrapped: "BSD",
        "You should have received a copy of the GNU General Public License\nalong with this package. If not, see https://www.gnu.org/licenses/": "GPL",
        "This module is free software; you can redistribute it under the terms of the GNU General Public License": "GPL",
        "Dual licensed under the MIT License or the Apache License": "Apache-2.0,MIT",
        "You may use this under the Apache License, Version 2.0": "Apache-2.0",
        "All content is under a Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA",
        "This file is subject to the terms of the Mozilla Public License, v. 2.0": "MPL",
    }
    plain = ["A fishing license is sold at the office.", "Students at MIT read the general terms of the public library.", "The version of the file that you obtain may not include all parts.", "He asked for permission to use the car of the company.", "Conditions in the mountains are hard, and any person must be careful."]
    data = [(i, f"Some words before.\n{t}\nAnd after.") for i, t in enumerate(marks)] + [(100 + i, t) for i, t in enumerate(plain)] + [(200, "All rights reserved."), (201, "Licensed under the Foo Bar License, version 7.")] + [(300, t) for t in plain] + [(None, "word " * 200_000 + "\nReleased under the MIT License.")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("license", F.lit("x"))
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    right = [got[i].families == v for i, v in enumerate(marks.values())]
    wrong = [(t, got[i].families) for i, t in enumerate(marks) if not right[i]]
    assert sum(right) >= len(marks) - 2, wrong
    assert all(set(got[i].families.split(",")) <= {*v.split(","), "unknown", ""} for i, v in enumerate(marks.values())), wrong
    assert all(got[100 + i].license == "none" for i in range(len(plain))), [got[100 + i] for i in range(len(plain))]
    assert got[200].families == got[201].families == "unknown" and got[None].families == "MIT"
    assert got[list(marks).index(wrapped)].n_licensed == 1


def test_license_classifier_on_held_out_variants():
    rng = random.Random(77)
    model = licenses.train(["a plain sentence about the work of the day"] * 30)
    tests = [(licenses._variants(line, rng), k) for k, f in enumerate(model.families) for line in licenses.TEMPLATES[f] for _ in range(5)]
    h, _, _, first = words.words_of(pa.array([t for t, _ in tests]), alnum=True)
    p = model.probabilities(h, first)
    assert np.mean(p[:, :-2].argmax(1) == np.array([k for _, k in tests])) > 0.95
    assert 0.5 <= model.least <= 0.9


def test_sainte_lague_by_hand():
    def slow(votes, seats):
        s = [0] * len(votes)
        for _ in range(seats):
            k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * s[i] + 1), -i))
            s[k] += 1
        return s

    rng = random.Random(3)
    for _ in range(60):
        votes = [rng.randrange(0, 50) for _ in range(rng.randrange(1, 9))]
        if sum(votes):
            seats = rng.randrange(1, 60)
            assert mixing.sainte_lague(votes, seats).tolist() == slow(votes, seats)
    assert mixing.sainte_lague([5, 5, 5], 4).tolist() == [2, 1, 1]
    assert mixing.sainte_lague([], 3).tolist() == [] and mixing.sainte_lague([0, 0], 3).tolist() == [0, 0]


def test_mixing(spark, docs, rows, empty):
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(split(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in rest)
        over = {s for s in rest if weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        full |= over
    target = {s: 3.0 * sizes[s] if s in full else weight[s] * level for s in names}
    mix = mixing.mix_sources(docs, block=16, shard_tokens=1000)
    got = mix.collect()
    assert len(got) == len(rows)
    taken = collections.Counter()
    for g in got:
        assert g.target == pytest.approx(target[g.source]) and g.source_size == sizes[g.source]
        assert 0 <= g.taken <= 3 * g.size
        taken[g.source] += g.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(40, 0.03 * target[s])
    again = mixing.mix_sources(docs.repartition(2), block=16, shard_tokens=1000).collect()
    key = lambda g: (str(g.doc_id), str(g.source), g.size, g.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] == 0
