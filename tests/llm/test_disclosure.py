import math
from collections import Counter, defaultdict

import brute
import pytest

from pitline.llm import pii

ROWS = [(i, f"the quick words of text number n{i} go on and on with {'w%d' % (i % 7)}xyz") for i in range(60)]
ROWS += [
    (100, "Yours, Kowalski. " + "the quick words go on and on " * 3 + "mail kow@example.com or 10.1.2.3, says kowalski"),
    (101, "the quick words, Nowak77 writes from now@example.com"),
    (102, "the quick words, Nowak77 again, now@example.com and " + "so on " * 40 + "nowak77"),
    (103, "the quick words by 王伟 and +1 (415) 555-2671"),
    (104, "the quick words by Kowalski"),
    (105, None),
]


def plain_spans(rows, generalise=pii.GENERALISE, remove=pii.REMOVE):
    """Disclosing term spans of every text, from whole texts and all pairs."""
    words = lambda t: [m for m in pii.re.finditer(r"\w{2,}", t or "") if (len(m.group()) > 2 and any(c.isalpha() for c in m.group())) or (m.group().isalpha() and m.group().lower() == m.group().upper())]
    terms = {d: {m.group().lower() for m in words(t)} for d, t in rows}
    base = {d: brute.personal(t) for d, t in rows}
    value = lambda k, v: (k, v.lower() if k in ("email", "ip") else "".join(c for c in v if c.isdigit()))
    entities = {d: {value(k, t[a:b]) for k, a, b in base[d]} for d, t in rows}
    outside = {d: [m for m in words(t) if all(m.end() <= a or b <= m.start() for _, a, b in base[d])] for d, t in rows}
    n_term = Counter(x for d in terms for x in terms[d])
    n_entity = Counter(e for d in entities for e in entities[d])
    both = Counter((e, x) for d in entities for e in entities[d] for x in {m.group().lower() for m in outside[d]})
    n, out = len(rows), defaultdict(list)
    ratio = lambda e, x: math.log2(both[e, x] * n / n_entity[e] / n_term[x]) / math.log2(n / n_entity[e])
    for d in entities:
        for m in outside[d] if entities[d] else []:
            best = max((ratio(e, m.group().lower()) for e in entities[d] if n_entity[e] < n), default=-1)
            if best >= generalise - 1e-9:
                out[d].append(("removed" if best >= remove - 1e-9 else "term", *m.span()))
    return {d: sorted(out[d]) for d, _ in rows}


def found_spans(docs):
    return {r["doc_id"]: [tuple(s) for s in r["terms"]] for r in pii.find_spans(docs).collect()}


def test_term_spans_equal_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert found_spans(docs) == plain_spans(ROWS)
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = plain_spans([tuple(r) for r in documents.collect()])
    assert found_spans(documents) == want and any(want.values())


@pytest.mark.parametrize("doc, names", [(100, ["Kowalski", "kowalski"]), (101, ["Nowak77"]), (102, ["Nowak77", "nowak77"]), (103, ["王伟"])])
def test_values_of_few_documents_are_protected(spark, doc, names):
    """Names by a value of one or two documents, far from it, in every place, with digits, and of two letters."""
    text = dict(ROWS)[doc]
    hidden = [text[a:b] for _, a, b in found_spans(spark.createDataFrame(ROWS, "doc_id long, text string"))[doc]]
    assert all(hidden.count(x) == names.count(x) for x in names) and not {"the", "quick", "words"} & set(hidden)
