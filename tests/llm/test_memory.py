"""What workers hold, and how many of them a task needs."""

import psutil
from cases import prose

import corpus_pipeline
from furrow.llm import common


def most_python(node, over: int = 0) -> int:
    """The most Python nodes of one stage, each of which has a worker of its own in every task."""
    name = node.nodeName()
    over = 0 if "Exchange" in name else over + ("Pandas" in name or "Arrow" in name)
    below = node.children()
    return max([over, *(most_python(below.apply(k), over) for k in range(below.size()))])


def test_no_stage_of_repeats_has_two_workers_in_a_task(spark, monkeypatch):
    found, save = [], common.Scratch.save

    def saved(self, df):
        found.append(most_python(df._jdf.queryExecution().executedPlan()))
        return save(self, df)

    monkeypatch.setattr(common.Scratch, "save", saved)
    passage = " ".join(prose(7, 90).split())
    docs = spark.createDataFrame([(k, f"{prose(10 + k, 40)} {passage if k % 2 else ''}", "en", "s", 0) for k in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan hides its nodes
    try:
        out = corpus_pipeline.without_repeats(spark, docs, "")
        found.append(most_python(out._jdf.queryExecution().executedPlan()))
        assert sum(passage not in r["text"] for r in out.collect()) == 12
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(found) >= 5 and max(found) == 1


def test_what_a_group_took_is_given_back():
    def held() -> float:
        return psutil.Process().memory_info().rss / 1e6

    pinned = []

    def group(size: int) -> int:
        parts = [bytearray(1500) for _ in range(size)]
        pinned.append(bytearray(1500))  # above what is freed, so that the end of the heap can't move
        return sum(map(len, parts))

    before = held()
    assert common.lean(group)(150_000) == 225_000_000
    assert held() - before < 90
    assert len(pinned) == 1
