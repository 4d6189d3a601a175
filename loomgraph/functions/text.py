"""Scalar functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = tuple("a an and are as at be but by for from has have he her his if in into is it its no not of on or our she such that the their then there these they this to was were which will with you".split())
CLASSIFIER_SUFFIXES = ("product", "food", "material", "type", "group", "category", "class")


def normalise(name: Column) -> Column:
    """Lower-case, runs of other than a-z and 0-9 to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def content_tokens(text: Column) -> Column:
    """Lower-case word tokens of three letters or more, stop words left out."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z][-a-z]{2,})"), F.lit(1)), lambda t: ~F.array_contains(stop, t))


def slug(text: Column, limit: int = 48) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.substring(s, 1, limit)
    return F.when(s == "", "unlabeled").otherwise(s)


def prefix_of(term: Column) -> Column:
    return F.when(F.instr(term, ":") > 0, F.substring_index(term, ":", 1)).otherwise("")


def snippet(text: Column, limit: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def shorten_uri(uri: Column) -> Column:
    """OBO purls (http or https) to ``PREFIX:local``, for upper-case prefixes; other strings stay."""
    tail = F.regexp_replace(uri, "^https?:[/][/]purl[.]obolibrary[.]org[/]obo[/]", "")
    short = (tail != uri) & tail.rlike("^[A-Z]{1,}_[a-zA-Z0-9]{1,}$")
    return F.when(short, F.translate(tail, "_", ":")).otherwise(uri)


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space; blank pieces left out."""
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda s: F.length(s) > 0)


def is_prose(sentence: Column) -> Column:
    """Three alphabetic words, or letters in at least two fifths of all characters."""
    letters = F.length(F.regexp_replace(sentence, "[^A-Za-z]", ""))
    return (F.regexp_count(sentence, F.lit(r"\b[A-Za-z]{2,}\b")) >= 3) | (letters >= 0.4 * F.length(sentence))


def is_garbage(term: Column) -> Column:
    """Keyword candidates with a digit, of one or two characters, or in capitals of four or more."""
    return F.exists(F.split(term, " "), lambda t: t.rlike("[0-9]") | (F.length(t) <= 2) | ((F.length(t) >= 4) & ~t.rlike("[^A-Z0-9]")))


def is_scaffolding(label: Column, synonym_count: Column) -> Column:
    last = F.element_at(F.split(F.lower(F.trim(label)), r"\s+"), -1)
    return (synonym_count == 0) & last.isin(*CLASSIFIER_SUFFIXES)


def hash_embedding(text: Column, size: int) -> Column:
    """Deterministic vector from the SHA-256 digest's bytes, each over 255."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.conv(F.substring(digest, 1 + 2 * (i % 32), F.lit(2)), 16, 10).cast("double") / F.lit(255.0))


def cache_key(*parts: Column) -> Column:
    """SHA-256 over length-prefixed parts, so that no two part lists collide by concatenation."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]), 256)


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unlike lengths and zero norms."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def year_of(value: Column) -> Column:
    """Integers, whole floats and all-digit strings; else null."""
    v = F.trim(value)
    return F.when(v.rlike("^[0-9]+$"), v.try_cast("int")).when(v.rlike(r"^[0-9]+\.0+$"), F.substring_index(v, ".", 1).try_cast("int"))


def section_of(source_type: Column) -> Column:
    return F.when(source_type == "abstract", "abstract").when(source_type == "guide", "guideline").otherwise("textbook")


def shelf_id_of(facet: Column, term: Column) -> Column:
    """A shelf's id: its facet and its term."""
    return F.concat(F.lit("facet:"), facet, F.lit("/"), term)


def term_of_shelf(shelf: Column) -> Column:
    """The term of a shelf id; null for a facet's own root, which has none."""
    return F.when(F.startswith(shelf, F.lit("facet:")) & F.contains(shelf, F.lit("/")), F.regexp_replace(shelf, "^facet:[^/]*/", ""))


def clean_label(label: Column) -> Column:
    """Without a trailing classifier of food products, trimmed; a label of nothing else stays."""
    short = F.trim(F.regexp_replace(F.trim(label), r"(?i)\s+food product$", ""))
    return F.when(short == "", F.trim(label)).otherwise(short)


def term_text(label: Column, synonyms: Column, separator: str = " ; ", limit: int = 5) -> Column:
    """A term as one text for encoders: its label and the first ``limit`` synonyms."""
    return F.array_join(F.concat(F.array(label), F.slice(F.coalesce(synonyms, F.array().cast("array<string>")), 1, limit)), separator)


def json_object(reply: Column) -> Column:
    """The outermost {...} of a model's reply, without fences and prose, as text; null where there is none that parses."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when((body != "") & F.get_json_object(body, "$").isNotNull(), body)


def source_of(discovery_pass: Column) -> Column:
    """Name of a theme's source by the pass that found it."""
    return F.when(discovery_pass == "merged", "merged").when(discovery_pass == "relatedness", "relatedness_only").when(discovery_pass.isin("global_similarity", "per_shelf_similarity", "bertopic"), "similarity_only").otherwise("other")


def clamp_words(text: Column, limit: int = 2000) -> Column:
    """At most ``limit`` characters, cut at the last blank within them."""
    head = F.substring(text, 1, limit)
    whole = F.length(text) <= limit
    cut = F.regexp_extract(head, r"(?s)^(.*)\s\S*$", 1)
    return F.when(whole, text).when(cut == "", head).otherwise(F.rtrim(cut))


def is_real_embedding(model: Column) -> Column:
    """Vectors of a named model that is no stand-in."""
    return model.isNotNull() & ~F.startswith(F.lower(model), F.lit("mock")) & ~F.startswith(F.lower(model), F.lit("hash"))
