"""Sets that share much with a leader but are far from it."""

import random

import pytest
from brute_sets import components
from lodegraph.llm import jaccard


def test_sets_far_from_leaders_bring_no_differences_and_lose_no_link(spark, monkeypatch):
    rng = random.Random(5)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template = own(150)
    texts = [template + own(150) for _ in range(20)]
    texts += [t[:-4] + own(4) for t in texts[10:14]]
    made, save = {}, jaccard.Scratch.save

    def spied(self, df, name):
        out = save(self, df, name)
        if name == "differences":
            made["far"], made["kept"] = out.count(), out.where("size(delta) > 50").count()
        return out

    monkeypatch.setattr(jaccard.Scratch, "save", spied)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.classes(df, k=5, num=80).collect()}
    assert got == {k: k - 10 if k >= 20 else k for k in range(24)}
    assert made["far"] > 20 and made["kept"] == 0


def test_near_copies_far_from_their_leader_do_not_make_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"b{k}" for k in range(300)]

    def changed(places: int) -> str:
        out = list(base)
        for at in rng.sample(range(2, 298), places):
            out[at] = f"w{rng.randrange(10**9)}"
        return " ".join(out)

    texts = [changed(k) for k in [2] * 80 + [14] * 80]  # the latter link with nothing, but lead buckets
    found, save = {}, jaccard.Scratch.save

    def spied(self, df, name):
        out = save(self, df, name)
        if name in ("beyond", "near"):
            found[name] = out.count()
        return out

    monkeypatch.setattr(jaccard.Scratch, "save", spied)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.classes(df).collect()}
    roots = components(texts, 3, 90, 100)
    assert got == {k: roots.index(r) for k, r in enumerate(roots)}
    assert found["beyond"] > 80 and found["near"] < 100


@pytest.mark.parametrize("some", [jaccard.SOME, 3])
def test_groups_of_fewer_pairs_than_tokens_give_their_pairs(spark, monkeypatch, some):
    rng = random.Random(11)
    base = [f"b{k}" for k in range(300)]

    def changed(words: list[str], places: int) -> list[str]:
        out = list(words)
        for at in rng.sample(range(2, 298), places):
            out[at] = f"w{rng.randrange(10**9)}"
        return out

    texts = [changed(base, 5) for _ in range(30)]  # within 2.5 times a link's distance of each other, and not linked
    texts = [" ".join(t) for t in texts + [changed(t, 2) for t in texts[10:18]]]
    made, save = {"tokens": 0}, jaccard.Scratch.save

    def spied(self, df, name):
        out = save(self, df, name)
        if name == "centred":
            made["tokens"] += out.groupBy().sum("d").first()[0] or 0
        elif name == "between":
            made[name], made["distinct"] = out.count(), out.distinct().count()
        return out

    monkeypatch.setattr(jaccard, "SOME", some)
    monkeypatch.setattr(jaccard.Scratch, "save", spied)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.classes(df).collect()}
    roots = components(texts, 3, 90, 100)
    assert got == {k: roots.index(r) for k, r in enumerate(roots)} and len(set(got.values())) == 30
    if some == 3:  # the same by tokens
        assert made["tokens"] > 500
    else:
        assert not made["tokens"] and 0 < made["between"] == made["distinct"] <= 38 * 37 // 2
