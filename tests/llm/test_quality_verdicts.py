import random
from collections import defaultdict

import brute
import numpy as np

from pitline.llm import quality


def plain_verdicts(rows):
    """kept by row from a plain MCD over all vectors of a group; rows: (text, lang, source)."""
    counts = [brute.counts(t) for t, _, _ in rows]
    failed = [c[0] < 20 or 100 * c[4] > 30 * c[0] for c in counts]
    x = np.array([[np.log(max(w, 1)), np.log((ch + 1) / max(w, 1)), np.sqrt(sy / max(ch, 1)), np.sqrt(dup / max(w, 1)), np.sqrt(rep / max(w, 1))] for w, ch, sy, dup, rep in counts])
    floor = np.diag(np.square([0.25, 0.05, 0.05, 0.08, 0.15]))
    # 0.75 / P(chi2 with 7 degrees <= q), q the 0.75 quantile of chi2 with 5, from sums of squares of normal numbers
    normal = np.random.default_rng(1).normal(size=(400_000, 7)) ** 2
    scale = 0.75 / (normal.sum(axis=1) <= np.quantile(normal[:, :5].sum(axis=1), 0.75)).mean()
    assert abs(quality.consistency(0.75) - scale) < 0.01
    scale = quality.consistency(0.75)

    def distances(v, center, scatter):
        return np.einsum("ij,jk,ik->i", v - center, np.linalg.inv(scatter + floor), v - center)

    def step(v, center, scatter):
        d = distances(v, center, scatter)
        near = v[d <= np.quantile(d, 0.75, method="inverted_cdf")]
        return near, near.mean(axis=0), np.cov(near.T, bias=True).reshape(5, 5) * scale

    def logdet(state):
        return np.linalg.slogdet(state[2] + floor)[1]

    def subset(v):
        q = np.quantile(v, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
        m, s = q[1], np.sqrt(((q[2] - q[0]) / 1.349) ** 2 + np.diag(floor))
        z = (v - m) / s
        sign = np.array([r / np.linalg.norm(r) if r.any() else r for r in z])
        states = []
        for form in (None, np.tanh(z), sign):
            r = np.eye(5)
            if form is not None:
                c = np.cov(form.T, bias=True).reshape(5, 5) + 1e-9 * np.eye(5)
                r = c / np.sqrt(np.outer(np.diag(c), np.diag(c)))
            state = (None, m, r * np.outer(s, s) - floor)
            for _ in range(2):
                state = step(v, *state[1:])
            states.append(state)
        return descend(v, min(states, key=logdet))

    def descend(v, state):
        best = state
        for _ in range(20):
            after = step(v, *state[1:])
            best = min(best, after, key=logdet)
            if logdet(after) >= logdet(state) - 1e-4:
                return best[0]
            state = after
        return best[0]

    members = defaultdict(list)
    for i, r in enumerate(rows):
        if not failed[i]:
            members[r[1:]].append(i)
    near = {g: subset(x[m]) for g, m in members.items()}

    def parent(children, v):
        merged = np.vstack(children)
        return descend(v, step(v, merged.mean(axis=0), np.cov(merged.T, bias=True).reshape(5, 5) * scale))

    of_lang = {la: parent([n for g, n in near.items() if g[0] == la], x[[i for g, m in members.items() if g[0] == la for i in m]]) for la in {g[0] for g in members}}
    of_all = parent(list(of_lang.values()), x[[i for m in members.values() for i in m]])
    kept = []
    for i, r in enumerate(rows):
        if failed[i]:
            kept.append(False)
            continue
        center = scatter = None
        for v in (of_all, of_lang[r[1]], near[r[1:]]):
            own, spread = v.mean(axis=0), np.cov(v.T, bias=True).reshape(5, 5)
            w = 1 if center is None else len(v) / (len(v) + 100)
            center, scatter = (own, spread) if center is None else (w * own + (1 - w) * center, w * spread + (1 - w) * scatter)
        kept.append(bool(distances(x[i : i + 1], center, scatter * scale)[0] <= 25.745))
    return kept


def test_verdicts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", "source").collect()
    want = plain_verdicts([tuple(r)[1:] for r in rows])
    found = {r["doc_id"]: r["kept"] for r in quality.assess(docs).collect()}
    assert [found[r["doc_id"]] for r in rows] == want and not all(want)


def test_a_start_that_misleads_loses_to_one_of_less_determinant(spark):
    """Two dimensions that hang together: independent statistics begin with another subset than the bounded correlations."""
    rng = np.random.default_rng(4)
    a = rng.normal(0, 1, 1_500)
    good = np.column_stack([a, a + rng.normal(0, 0.05, 1_500), *rng.normal(0, 0.3, (3, 1_500))])
    bad = np.column_stack([rng.normal(0, 1, 500), rng.normal(0, 1, 500), *rng.normal(0, 0.3, (3, 500))])
    rows = spark.createDataFrame([("g", v.tolist()) for v in np.vstack([good, bad])], "g string, x array<double>")
    first = quality.starts(rows, ["g"])
    assert sorted(r["start"] for r in first.select("start").collect()) == [0, 1, 2]
    dets = [r["logdet"] for r in quality.concentrated(rows, ["g"], quality.starts(rows, ["g"])).orderBy("start").collect()]
    found = quality.solved(quality.least_determinant(rows, ["g"]), ["g"], lambda r: (quality.mean_and_scatter(r)[0], quality.mean_and_scatter(r)[1] * quality.consistency(0.75)))
    assert found.first()["logdet"] <= min(dets) + 1e-9 and max(dets) > min(dets)


def test_small_groups_are_judged(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(40, 90))), "en" if i % 2 else None, "abc"[i % 3] if i % 7 else None) for i in range(40)]
    rows += [(100, " | ".join(rng.choices(words, k=80)), "en", "alone"), (101, None, None, None), (102, "", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in quality.assess(docs).where("kept").collect()} == set(range(40))


def test_symbol_junk_goes_and_a_repeated_line_stays(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(800)]
    text = lambda n: "\n".join(" ".join(rng.choices(words, k=10)) for _ in range(n))
    rows = [(i, text(rng.randrange(6, 30)), "en", "a") for i in range(600)]
    for i in range(40):
        line = " ".join(rng.choices(words, k=9))
        rows.append((1_000 + i, f"{line}\n{text(rng.randrange(8, 20))}\n{line}", "en", "a"))
        rows.append((2_000 + i, " | ".join(rng.choices(words, k=rng.randrange(60, 200))), "en", "a"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.assess(docs).where("kept").collect()}
    assert not [d for d in kept if d >= 2_000] and len([d for d in kept if 1_000 <= d < 2_000]) == 40
    assert len([d for d in kept if d < 1_000]) >= 598
