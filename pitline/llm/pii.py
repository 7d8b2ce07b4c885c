"""Personal data: pattern spans, and terms of their documents that give the protected entity away.

Entities are the values that the patterns find (addresses, card and phone numbers). A term discloses an entity as far as their
pointwise mutual information reaches the entity's information content: PMI(e, t) / IC(e), both from document counts over the whole
corpus: documents with the entity, documents with the term, and documents with both. A ratio of one means that the term stands in
no other document than the entity's. In every document of the entity, all places of terms of a ratio from `generalise` on are
replaced by their kind of word, and those of terms of a ratio from `remove` on are taken out. There is no least number of
documents: a value that stands in one document is disclosed by the terms that few other documents hold.

Both counts bound the documents with both, so PMI <= log2(N / n_term) for any pair: pairs whose term is too common for `generalise` by
that bound are dropped before they are counted, and no other. The rest are linear in the terms of documents with entities, times
the entities of the document. Pairs, entities and terms are counted by sums that combine before their shuffle. Texts take part in no
shuffle when spans are asked for.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitline.llm.common import by_batch, discard, parted, row_key, written

KINDS = ("email", "ip", "card", "phone")
GENERALISE = 0.5
REMOVE = 0.8
#: Distinct terms that a task counts in memory before it hands them on.
COUNTER_ENTRIES = 500_000

# fixed values: the patterns of the kinds
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"\w{2,}")


def email_spans(text: str) -> list[tuple[int, int]]:
    """Found from the @ signs, in time linear in the text however long its words are."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free))
        at = text.find("@", free if domain else at + 1)
    return found


def ip_spans(text: str) -> list[tuple[int, int]]:
    small = lambda part: len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def card_spans(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and the 18 signs that may part them
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def phone_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


_FINDERS = dict(zip(KINDS, (email_spans, ip_spans, card_spans, phone_spans), strict=True))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    return [(kind, a, b) for kind, find in _FINDERS.items() for a, b in find(text)]


def entity_of(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(c for c in value if c.isdigit())}"


def is_term(run: str) -> bool:
    """Three or more word characters, one of them a letter, or two letters of a script without cases."""
    if len(run) == 2:
        return run.isalpha() and run.lower() == run.upper()
    return any(map(str.isalpha, run))


def terms_of(text: str) -> set[str]:
    """The distinct terms of a text, in lower case."""
    return {run.lower() for run in set(_RUN.findall(text)) if is_term(run)}


def places(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Every place of a term outside all spans: term, start, end."""
    taken: list[list[int]] = []  # the spans as disjoint ranges
    for a, b in sorted((a, b) for _, a, b in spans):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    begins = [a for a, _ in taken]
    free = lambda s, e: not (i := bisect_left(begins, e)) or taken[i - 1][1] <= s
    return [{"term": m.group().lower(), "start": m.start(), "end": m.end()} for m in _RUN.finditer(text) if is_term(m.group()) and free(*m.span())]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
NEAR = T.StructType([T.StructField("term", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = T.StructType([T.StructField("base", T.ArrayType(SPAN), False), T.StructField("entities", T.ArrayType(T.StringType()), False), T.StructField("near", T.ArrayType(NEAR), False)])


def with_base(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Columns `keep` of docs, `base` spans, distinct `entities`, and `near`, the places of all terms of a text with entities."""

    def run(batch: pa.RecordBatch) -> dict:
        base, entities, near = [], [], []
        for t in batch.column("llm_text").to_pylist():
            spans = base_spans(t) if t else []
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            entities.append(sorted({entity_of(k, t[a:b]) for k, a, b in spans}))
            near.append(places(t, spans) if spans else [])
        return {"base": base, "entities": entities, "near": near}

    return by_batch(docs.select(*keep, F.col(text).cast("string").alias("llm_text")), run, keep, FOUND)


def document_counts(docs: DataFrame, text: str) -> DataFrame:
    """(term, n): in how many documents each term stands, over all documents. Tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = list(counts.items())
            counts.clear()
            for at in range(0, len(items), 50_000):
                terms, ns = zip(*items[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(ns, pa.int64())], names=["term", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(terms_of(t))
                    if len(counts) > COUNTER_ENTRIES:
                        yield from out()
        yield from out()

    partial = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "term string, n long")
    return partial.groupBy("term").agg(F.sum("n").alias("n"))


def pairs_of_rows(docs: DataFrame, found: DataFrame, text: str, least: float | None) -> DataFrame:
    """(at, entity, term, n_entity, n_term, n_docs): every entity and term of a row whose ratio may be `least`, or all without one.

    docs: all documents; found: `at`, their `entities` and `near` lists. An entity that stands in every document has no information
    to disclose.
    """
    n = F.lit(float(docs.count()))
    entities = written(found.select("at", F.explode("entities").alias("entity")), "entities")
    counted = entities.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") < n)
    entities = written(entities.join(counted, "entity"), "entities")
    terms = found.where(F.size("entities") > 0).select("at", F.explode(F.array_distinct(F.col("near")["term"])).alias("term"))
    terms = written(terms, "terms")
    known = document_counts(docs, text).join(terms.select("term").distinct(), "term", "left_semi").withColumnRenamed("n", "n_term")
    known = written(known, "known")
    if least is not None:  # by the bound no term with more documents discloses even the most common entity
        most = entities.agg(F.max("n_entity").alias("most"))
        known = known.crossJoin(F.broadcast(most)).where(possible(n, F.col("most"), least)).drop("most")  # one row
    pairs = terms.join(known, "term").join(entities, "at")
    if least is not None:
        pairs = pairs.where(possible(n, F.col("n_entity"), least))
    return pairs.select("at", "entity", "term", "n_entity", "n_term", n.alias("n_docs"))


def possible(n: Column, n_entity: Column, least: float) -> Column:
    """Whether log2(N / n_term), the most that the PMI can be, reaches `least` of the entity's information content."""
    return F.log2(n / F.col("n_term")) >= least * F.log2(n / n_entity) - 1e-9


def rated(pairs: DataFrame) -> DataFrame:
    """(entity, term, ratio) of the pairs of rows."""
    both = pairs.groupBy("entity", "term", "n_entity", "n_term", "n_docs").agg(F.count("*").alias("both"))
    content = F.log2(F.col("n_docs") / F.col("n_entity"))
    pmi = F.log2(F.col("both") * F.col("n_docs") / (F.col("n_entity") * F.col("n_term")))
    return both.select("entity", "term", (pmi / content).alias("ratio"))


def disclosing_pairs(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """(entity, term, ratio) of all pairs that stand together in a document."""
    numbered = written(found.withColumn("at", F.monotonically_increasing_id()).select("at", "entities", "near"), "spans")
    return rated(pairs_of_rows(docs, numbered, text, None))


def term_spans(docs: DataFrame, found: DataFrame, text: str, generalise: float, remove: float) -> DataFrame:
    """(at, terms): for each row number of `found` the spans of its disclosing terms, kinds `term` (generalised) and `removed`."""
    found = found.select("at", "entities", "near")
    pairs = written(pairs_of_rows(docs, found, text, min(generalise, remove)), "pairs")
    disclosing = written(rated(pairs).where(F.col("ratio") >= generalise - 1e-9), "disclosing")
    hits = pairs.join(disclosing, ["entity", "term"]).groupBy("at", "term").agg(F.max("ratio").alias("ratio"))
    near = found.select("at", F.explode("near").alias("w")).select("at", "w.*")
    kind = F.when(F.col("ratio") >= remove - 1e-9, "removed").otherwise("term")
    return near.join(hits, ["at", "term"]).groupBy("at").agg(F.sort_array(F.collect_list(F.struct(kind.alias("kind"), F.col("start").alias("start"), F.col("end").alias("end")))).alias("terms"))


def find_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per row of docs: its id, `base` (array of kind, start, end) and `terms` (the same for the disclosing terms).

    Spans are in code points of the whole text, ends exclusive. A null or empty text has none. Repeated rows count as documents
    of their own and each get their spans; ids may be null. In a corpus without entities no term is disclosing.
    """
    slim = docs.select(F.col(id).alias("id"), F.col(text).alias("llm_in"))
    found = written(with_base(slim, ["id"], "llm_in").withColumn("at", F.monotonically_increasing_id()), "spans")  # written: the numbers hold
    terms = term_spans(docs, found, text, generalise, remove)
    return found.join(terms, "at", "left").select(F.col("id").alias(id), "base", F.coalesce("terms", F.array().cast(T.ArrayType(SPAN))).alias("terms"))


def shape(term: str) -> str:
    return "[NAME]" if term[:1].isupper() else "[WORD]"


def hidden(text: str, spans: list[dict]) -> str:
    """The text with its spans replaced from left to right; of overlapping spans the first and longest counts."""
    out, free = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] < free:
            continue
        old = text[s["start"] : s["end"]]
        out += [text[free : s["start"]], "" if s["kind"] == "removed" else shape(old) if s["kind"] == "term" else f"[{s['kind'].upper()}]"]
        free = s["end"]
    return "".join([*out, text[free:]])


def sanitise(docs: DataFrame, text: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """docs with the spans of `find_spans` replaced in the text; every row stays, and a null text stays null.

    A text's spans follow from the text and the corpus, so they are found for narrow rows with a key of the text, of which only those with
    spans are written; whole rows are shuffled only where their key may be one of these.
    """
    key = row_key(F.col(text).cast("string"))
    slim = docs.select(*key, F.col(text).alias("llm_in"))
    found = with_base(slim, ["k1", "k2"], "llm_in").where(F.size("base") > 0)
    found = written(found.withColumn("at", F.monotonically_increasing_id()), "spans")  # written: the numbers hold
    every = F.concat("base", F.coalesce("terms", F.array().cast(T.ArrayType(SPAN))))
    spans = found.join(term_spans(docs, found, text, generalise, remove), "at", "left").select("k1", "k2", every.alias("all"))
    spans = written(spans.dropDuplicates(["k1", "k2"]), "hidden")
    discard(found)
    hit, rest = parted(docs, key, spans)
    rows = hit.join(spans, ["k1", "k2"], "left").select("row", "all", F.col("row")[text].cast("string").alias("llm_in"))

    def run(batch: pa.RecordBatch) -> dict:
        texts, spans = batch.column("llm_in").to_pylist(), batch.column("all").to_pylist()
        return {"clean": [hidden(t, s) if t and s else t for t, s in zip(texts, spans, strict=True)]}

    out = by_batch(rows, run, ["row"], T.StructType([T.StructField("clean", T.StringType())]))
    patched = out.select(*[F.col("clean").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
    return rest.withColumn(text, F.col(f"`{text}`").cast("string")).unionByName(patched)
