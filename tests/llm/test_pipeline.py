"""The pipeline, each stage against brute force on what the stage before it kept."""

from __future__ import annotations

import itertools
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from ordina.llm import quality, secrets
from ordina.llm.common import materialise

from .test_operators import WORD, _secret_spans, corpus, goals_of, least_reachable, shingles

ITEM = "the quick brown Fox runs over 12 lazy dogs while Anna sings another very long song about rivers and green hills"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = [(r[0], r[1], "en", r[2], len(r[1] or "")) for r in corpus(5) if r[0] is not None]
    n = len(rows)
    more = ['key token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end of it', f"first of all {ITEM} and then", f"oh {ITEM.replace('Anna', 'Ben').replace('12', '40')} yes", "junk ### $$$ ### %%% ### " * 40]
    rows += [(n + i, t, "en", "a", len(t)) for i, t in enumerate(more)] + [(n + 50, more[0], "de", None, 5), (None, "a text without an id", "en", "b", 3)]
    rows += [(n + 100 + i, "word ### %%% *** $$$ " * (5 + i), "en", "c", 9) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_score", F.lit(1.0)).withColumn("taken", F.lit("x"))
    docs.write.parquet(f"{folder}/documents.parquet")
    good = [(r[0], 0 if "%%%" in (r[1] or "") else 1, 0) for r in rows if r[0] is not None]
    spark.createDataFrame(good, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in P.STAGES:
        out.append(materialise(stage(spark, out[-1], str(folder)), "step"))
    return str(folder), [(x.columns, x.collect()) for x in out]


def test_columns(steps):
    columns = [c for c, _ in steps[1]]
    assert columns[0] == columns[1] == columns[2] == columns[3] == columns[4]
    assert columns[5] == [*[c for c in columns[0] if c != "taken"], *P.MIX_COLUMNS]


def test_quality_stage(spark, steps):
    folder, rows = steps
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scored = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")), name="p").where("p >= 0.3")
    assert sorted(map(str, scored.select(*docs.columns).collect())) == sorted(map(str, rows[1][1]))
    assert not any("%%%" in (r.text or "") for r in rows[1][1]) and sum("%%%" not in (r.text or "") for r in rows[0][1]) - len(rows[1][1]) <= 2


def test_jaccard_stage(steps):
    """One row of each component stays: the smallest id, and one of rows that repeat it."""
    before, after = steps[1][1][1], steps[1][2][1]
    sets = [shingles(r.text, 5) for r in before]
    links = [(i, j) for i, j in itertools.combinations(range(len(before)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    group = least_reachable(len(before), links, list(range(len(before))))
    roots = least_reachable(len(before), links, [r.doc_id for r in before])
    want = {g: str(r) for r, s, g, root in zip(before, sets, group, roots) if s and root == r.doc_id}
    assert sorted([*want.values(), *(str(r) for r, s in zip(before, sets) if not s)]) == sorted(map(str, after)) and len(after) < len(before)


def test_jaccard_stage_takes_five_words_and_four_fifths(spark):
    """Copies with a sixth of the text added in the middle or cut off, and ones with more, against brute force at 5/80."""
    rows = []
    for k in range(3):
        base = [f"v{k}_{i}" for i in range(120)]
        more = [f"u{k}_{i}" for i in range(60)]
        versions = [base, base[:100], base[:50] + more[:20] + base[50:], base[:50] + more[20:] + base[50:], [*more[:40], *base[40:]]]
        rows += [(len(rows) + i, " ".join(v)) for i, v in enumerate(versions)]
    sets = [shingles(t, 5) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = [i for i, root in enumerate(least_reachable(len(rows), links, [r[0] for r in rows])) if root == i]
    got = P.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == want and len(want) == 9


def test_decontamination_stage(steps):
    before, after = steps[1][2][1], steps[1][3][1]
    held = [r for r in before if re.search("brown Fox runs over", r.text or "")]
    assert len(held) == 2 and sorted(map(str, [r for r in before if r not in held])) == sorted(map(str, after))


def test_secret_stage(steps):
    before, after = steps[1][3][1], steps[1][4][1]
    assert len(before) == len(after)
    kept = {str(r) for r in before}
    for r in after:
        assert not _secret_spans(r.text or "")
        assert str(r) in kept or ("[secret]" in r.text and r.n_chars == len(r.text))
    assert sum("[secret]" in (r.text or "") for r in after) == sum(bool(_secret_spans(r.text or "")) for r in before) > 0


def test_mixing_stage(spark, steps):
    before, after = steps[1][4][1], steps[1][5][1]
    by: dict = {}
    for r in before:
        by[r.source] = by.get(r.source, 0) + len(WORD.findall(r.text or ""))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    goals = dict(zip(names, goals_of([by[s] for s in names])))
    for s in names:
        assert sum(r.taken for r in after if r.source == s) == int(goals[s])
    assert all(0 < r.taken <= 2 * r.size for r in after)


def test_run(spark, steps):
    assert sorted(map(str, P.run(spark, steps[0]).collect())) == sorted(map(str, steps[1][5][1]))


def test_empty(spark, steps, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{steps[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
    assert secrets.redact(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect() == []
