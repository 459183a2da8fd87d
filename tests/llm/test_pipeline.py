"""The pipeline's stages against plain Python, one after another."""

import random
from collections import Counter

import corpus_pipeline as cp
from depthloom.llm import mixing
from tests.llm.test_near import WORD, plain_set


def texts(rng):
    word = lambda: "".join(rng.choices(["ka", "to", "mi", "ren", "sol", "vi"], k=rng.randint(1, 4)))
    for i in range(260):
        lines = [" ".join(word() for _ in range(rng.randint(8, 30))) for _ in range(rng.randint(1, 5))]
        if i % 4 == 0:
            lines.insert(0, "All rights of this page are kept")
        toxic = i % 6 == 1
        if toxic:
            lines.append(" ".join(rng.choice(["grumbus", "snarfel", "wuzzle"]) for _ in range(4)))
        yield "\n".join(lines), toxic


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    rows, toxic = [], set()
    for i, (text, bad) in enumerate(texts(rng)):
        rows.append((i, text, rng.choice(["en", "de"]), f"s{i % 3}", len(text)))
        toxic |= {i} if bad else set()
    for i in range(0, 60, 2):  # copies, one in two with a changed word at the end
        text = rows[i][1] + (" changed" if i % 4 else "")
        rows.append((1000 + i, text, rows[i][2], rows[i][3], len(text)))
        toxic |= {1000 + i} if i in toxic else set()
    rows += [(2000, "", "en", "s1", 0), (2001, None, None, None, None), (2002, "", "en", "s1", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] in toxic)) for r in rows], "doc_id long, toxic int").withColumn("quality", mixing.F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    one = cp.drop_toxic(spark, docs, str(tmp_path)).cache()
    left = {r["doc_id"]: r for r in one.collect()}
    assert one.columns == docs.columns and set(left) == {r[0] for r in rows} - toxic

    two = cp.drop_boilerplate(spark, one, str(tmp_path)).cache()
    pages, held = Counter(r["source"] for r in left.values()), Counter()
    for r in left.values():
        held.update({(r["source"], x) for x in (r["text"] or "").split("\n") if WORD.search(x)})
    drop = {k for k, n in held.items() if n >= 3 and n > 0.01 * pages[k[0]]}
    clean = {i: "\n".join(x for x in (r["text"] or "").split("\n") if (r["source"], x) not in drop) for i, r in left.items()}
    assert two.columns == docs.columns and {r["doc_id"]: r["text"] for r in two.collect()} == clean and any(clean[i] != (left[i]["text"] or "") for i in clean)

    three = cp.drop_near_duplicates(spark, two, str(tmp_path)).cache()
    sets, up = {i: plain_set(t) for i, t in clean.items()}, {i: i for i in clean}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in clean:
        for j in clean:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 10 * both >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    groups = {top(i) for i in clean}
    assert three.columns == docs.columns and sorted(r["doc_id"] for r in three.collect()) == sorted(groups) and len(groups) < len(clean)

    four = cp.mix_sources(spark, three, str(tmp_path))
    kept = {r["doc_id"] for r in four.collect()}
    assert four.columns == docs.columns and kept == {r["doc_id"] for r in mixing.mix(three).filter("mix_kept").collect()} and 0 < len(kept) < len(groups)

    out = cp.run(spark, str(tmp_path))
    pieces = out.collect()
    assert {r["doc_id"] for r in pieces} == kept
    whole = Counter()
    for r in pieces:
        whole[r["doc_id"]] += r["length"]
    assert all(whole[r["doc_id"]] == r["doc_tokens"] for r in pieces)
    assert cp.pack_sequences(spark, docs.limit(0), str(tmp_path)).count() == 0
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
