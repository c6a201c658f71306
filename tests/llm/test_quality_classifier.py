import math
import zlib

import zstandard

from runledger.llm import quality_classifier as qc
from tests.llm.conftest import documents, prose

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = qc.decisions(qc.score_quality(docs, labels))
    held = scored.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r for r in held if r["quality"] == 1], [r for r in held if r["quality"] == 0]
    assert len(good) > 500 and len(bad) > 80
    assert sum(r["predicted"] == 1 for r in good) / len(good) > 0.98
    assert sum(r["predicted"] == 0 for r in bad) / len(bad) > 0.9
    above = sum(g["score"] > b["score"] for g in good for b in bad) / (len(good) * len(bad))
    assert above > 0.99


def small(spark, n=60):
    rows = [(k, prose(k, 120) if k % 2 else "### $$$ | %% " * 40 + f" {k}") for k in range(n)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(n)] + [(None, 1, 0), (3, 1, 1), (999, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    return rows, labels


def test_edge_cases(spark, edge_rows):
    rows, labels = small(spark)
    rows += [(i + 1000 if i else i, t) for i, t in edge_rows]
    got = qc.decisions(qc.score_quality(documents(spark, rows), labels)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1001, 1002)}) == 1
    assert qc.score_quality(documents(spark, []), labels).count() == 0


def test_fold_zero_and_other_columns_do_not_matter(spark):
    rows, labels = small(spark)
    one = sorted(map(tuple, qc.score_quality(documents(spark, rows), labels).collect()))
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    flipped = labels.selectExpr("doc_id", f"CASE WHEN doc_id IN ({','.join(map(str, held))}) THEN 1 - quality ELSE quality END AS quality")
    other = documents(spark, [(d, t, f"source {d}") for d, t in rows], extra=False)
    assert held and sorted(map(tuple, qc.score_quality(other, flipped).collect())) == one


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows, labels = small(spark, 8)
    assert {r["score"] for r in qc.score_quality(documents(spark, rows), none).collect()} == {0.5}
    ones = labels.where("quality = 1")
    assert len({r["score"] for r in qc.score_quality(documents(spark, rows), ones).collect()}) == 1


def test_a_capped_sample_keeps_the_ratio_of_labels(spark, monkeypatch):
    rows = [(k, prose(k, 60, 300)) for k in range(900)]
    labels = spark.createDataFrame([(k, int(k % 7 != 0)) for k in range(900)], "doc_id long, quality int")
    docs = documents(spark, [*rows, (1000, "")])
    whole = qc.fit(docs, labels)
    monkeypatch.setattr(qc, "SAMPLE_ROWS", 80)
    capped = qc.fit(docs, labels)
    assert capped.prior == whole.prior > 0.8
    # Labels say nothing of these texts: scores lie about the share of label 1.
    means = [sum(qc.Scorer(f).score(t.encode()) for _, t in rows) / len(rows) for f in (whole, capped)]
    assert abs(means[0] - 6 / 7) < 0.06 and abs(means[1] - 6 / 7) < 0.06


def test_labels_of_unknown_ids_say_nothing(spark, monkeypatch):
    rows, labels = small(spark)
    monkeypatch.setattr(qc, "SAMPLE_ROWS", 40)
    docs = documents(spark, rows)
    unknown = spark.createDataFrame([(k, 0, 0) for k in range(10_000, 15_000)], "doc_id long, quality int, toxic int")
    assert qc.fit(docs, labels.unionByName(unknown)) == qc.fit(docs, labels)


def test_fit_against_a_plain_version(spark, monkeypatch):
    """Ids, prior, pieces of whole texts and features as plain Python finds them."""
    rows, labels = small(spark, 200)
    rows[1] = (1, " ".join(prose(k, 400) for k in range(900)))
    monkeypatch.setattr(qc, "SAMPLE_ROWS", 1000)
    trained = []
    plain = qc._trained
    monkeypatch.setattr(qc, "_trained", lambda pieces: trained.append(pieces) or plain(pieces))
    fitted = qc.fit(documents(spark, rows), labels)
    learned = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5]
    good = sum(k % 2 for k in learned)
    assert fitted.prior == (good + 1) / (len(learned) + 2)
    marks = spark.range(200).selectExpr("id", "pmod(xxhash64(id, 'role'), 2) AS m").collect()
    words = {r["id"] for r in marks if r["m"] == 0} & set(learned)
    for label in (0, 1):
        texts = [t.encode() for k, t in rows if k in words and k % 2 == label]
        assert set(trained[label]) == {t[j : j + 512] for t in texts for j in range(0, len(t), 512)}
        assert len(set(trained[label])) == len(trained[label])
    if 1 in words:
        assert len(trained[1]) > 4096
    text = rows[2][1].encode()
    sizes = []
    for data in (fitted.good, fitted.bad):
        packer = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_dict_id=False
        )
        sizes.append(sum(len(packer.compress(text[j : j + 1024])) for j in range(0, len(text), 1024)))
    difference, share, square = qc.Scorer(fitted).features(text)
    assert difference == (sizes[1] - sizes[0]) / sum(sizes)
    assert share == math.log(sizes[0] / len(text)) and square == share * share
