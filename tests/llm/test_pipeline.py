"""The pipeline's stages against plain Python that looks at everything."""

import random
import re

import numpy as np
import public_tokenizers as P
from cases import prose
from test_pairs import linked, near_family, removed_bytes, shingles
from tokenizers import Tokenizer

import corpus_pipeline
from furrow.llm import pii, toxicity
from furrow.llm.queries import PII_KEY


def rows():
    r = random.Random(7)
    out = [(i, t) for i, t, *_ in near_family()]
    for k in range(160):
        w = prose(4000 + k, 60).split()
        if k % 4 == 0:
            for b in r.sample(["scumbag", "worthless", "idiotic", "loathsome"], 3):
                w[r.randrange(60)] = b
        if k % 5 == 1:
            w[9:9] = [f"Mr John Smith{k % 3}," if k % 2 else "Mrs Anna Weber,", f"p.{k % 7}@mail.example.com", f"+1 (269) 555-{1000 + k % 9}"]
        out.append((1000 + k, " ".join(w)))
    passage = prose(60, 75)
    out += [(2000 + k, prose(70 + k, 30) + passage + prose(90 + k, 30)) for k in range(4)]
    return [(i, t, "en", f"s{k % 3}", len(t) if t else 0) for k, (i, t) in enumerate(out)]


def texts(df):
    return sorted(((str(r["doc_id"]), r["text"]) for r in df.collect()), key=str)


def settled(found):
    """Attempts by looking at all entities at once."""
    kinds: dict = {}
    for k, c in found:
        kinds.setdefault(k, set()).add(c)
    tries = {(k, c): pii.first_attempt(k, len(own)) for k, own in kinds.items() for c in own}
    while True:
        taken: dict = {}
        for (k, c), n in tries.items():
            taken.setdefault((k, pii.surrogate(PII_KEY, k, c, n)), []).append((n, c))
        again = [(k, c) for (k, s), who in taken.items() for n, c in who if s in kinds[k] or (len(who) > 1 and (n, c) != min(who))]
        if not again:
            return tries
        for x in again:
            tries[x] += 1


def test_stages_by_brute_force(spark, tmp_path):
    data = rows()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(1000 + k, 1, int(k % 4 == 0)) for k in range(160)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.createDataFrame(data, schema)
    stages = dict(corpus_pipeline.STAGES)

    model = toxicity.train(now, labels, toxicity.learns())
    score = toxicity.Scorer(model)
    want = [x for x in data if score(x[1] or "") < 0.5]
    now = stages["toxicity"](spark, now, str(tmp_path))
    assert texts(now) == sorted(((str(i), t) for i, t, *_ in want), key=str) and 30 <= len(data) - len(want) <= 60

    groups: dict = {}
    for k, (_, least) in enumerate(linked_rows(want)):
        groups.setdefault(least, []).append(k)
    keep = {min(own, key=lambda k: (want[k][0] is None, want[k][0] or 0, k)) for own in groups.values()}
    want = [x for k, x in enumerate(want) if k in keep]
    now = stages["near copies"](spark, now, str(tmp_path))
    assert texts(now) == sorted(((str(i), t) for i, t, *_ in want), key=str)

    removed = removed_bytes([(k, x[1]) for k, x in enumerate(want)], 400)
    now = stages["repeats"](spark, now, str(tmp_path))
    got = {(str(r["doc_id"]), r["source"]): r["text"] for r in now.collect()}
    for k, x in enumerate(want):
        assert len(got[str(x[0]), x[3]].encode()) == len((x[1] or "").encode()) - removed[k][0][1]
    assert sum(removed[k][0][1] for k in removed) > 1200
    want = [(i, t) for (i, _), t in got.items()]

    tries = settled({(k, c) for _, t in want for _, _, k, c in pii.entities(t)})
    now = stages["surrogates"](spark, now, str(tmp_path))
    assert texts(now) == sorted(((i, pii.rewrite(t, PII_KEY, tries, {})[0]) for i, t in want), key=str)
    assert sum(bool(pii.entities(t)) for _, t in want) > 20 and not any(re.search(r"John Smith|Anna Weber", r["text"]) for r in now.collect())

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    sizes = sorted(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts(now))
    out = stages["packing"](spark, now, str(tmp_path)).toPandas()
    assert sorted(out["length"]) == sorted(np.concatenate([[s % 2048 or 2048] + [2048] * ((s - 1) // 2048) for s in sizes]))
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == np.r_[0, own["length"].cumsum()[:-1]].tolist() and own["length"].sum() <= 2048


def linked_rows(data):
    """(links, the first row of its group) of each row, by comparing all pairs."""
    out = linked([(k, shingles(x[1])) for k, x in enumerate(data)], lambda a, b: a and b and 5 * len(a & b) >= 4 * len(a | b))
    return [out[k][0] for k in range(len(data))]


def test_passages_of_short_words_are_cut(spark):
    """Passages of over 50 words in under 400 bytes."""
    r = random.Random(5)
    short = lambda n: " ".join("".join(r.choice("abdeilnorstu") for _ in range(r.randint(2, 6))) for _ in range(n))
    passage = short(52)
    assert len(passage.encode()) < 350
    data = [(k, f"{short(20)}.{passage}{',;!'[k]}\n {short(9)}" if k < 3 else short(80)) for k in range(6)] + [(6, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["source"]: r for r in dict(corpus_pipeline.STAGES)["repeats"](spark, docs, "").collect()}
    inner = " ".join(passage.split()[1:-1])
    for k, (i, t) in enumerate(data):
        assert out[f"s{k}"]["doc_id"] == i and out[f"s{k}"]["text"] == (t or "").replace(inner, "") and out[f"s{k}"]["n_chars"] == len(out[f"s{k}"]["text"])
