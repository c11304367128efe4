"""Cases that earlier versions got wrong: names, keys, clashing columns, rows without ids of their own."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from fieldlark.llm import common, language_id, license_scan, line_dedup, pii_surrogates, sharding


def replaced(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii_surrogates.replace_entities(df, pii_surrogates.Surrogates("k")).collect()}


def test_common_words_stay_and_names_go(spark):
    got = replaced(
        spark,
        [
            "Mr. Will Long. It took a Long time", "Ms. May Day: in May it rains", "Mr. John Ronald Reuel Tolkien wrote. Tolkien smoked. John did not.", "Dear Maria Gonzalez, call 0171 555 0199", "Dear Sir or Madam, Dear Dr. Petra Vogel",
            "Dr. Will Long said so. Will Long left. Will went.", "Mr. Stone and the stone. Stone fell.", "Mrs. Anna Kowalska came, Kowalska left and Anna slept.",
        ],
    )
    text = {k: r.text for k, r in got.items()}
    assert text[0].endswith(". It took a Long time") and "Will" not in text[0]
    assert text[1].endswith(": in May it rains") and "Day" not in text[1]
    assert not re.search("John|Ronald|Reuel|Tolkien", text[2])
    assert not re.search("Maria|Gonzalez|0171|0199", text[3]) and text[3].startswith("Dear ") and got[3].kinds == ["name", "phone"]
    assert text[4].startswith("Dear Sir or Madam, Dear Dr. ") and not re.search("Petra|Vogel", text[4])
    assert "Will Long" not in text[5] and text[5].endswith(" Will went.")
    assert text[6].endswith(" and the stone. Stone fell.") and not text[6].startswith("Mr. Stone")
    assert not re.search("Anna|Kowalska", text[7])
    one = re.match(r"Mrs\. (\w+) (\w+) came, (\w+) left and (\w+) slept", text[7])
    assert one[1] == one[4] and one[2] == one[3]


def test_a_key_is_drawn_where_none_is_set(spark):
    name, before = "spark.fieldlark.surrogate.key", spark.conf.get("spark.fieldlark.surrogate.key", None)
    spark.conf.unset(name)
    try:
        with pytest.warns(UserWarning, match="unset"):
            one = common.secret_key(spark)
        assert len(one) == 64 and common.secret_key(spark) == one
        spark.conf.unset(name)
        with pytest.warns(UserWarning):
            assert common.secret_key(spark) != one
        spark.conf.set(name, "mine")
        assert common.secret_key(spark) == "mine"
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def test_columns_may_have_any_name(spark):
    line = "This one line stands in many a text and has a lot more than fifteen words in it, so it goes."
    names = ["_row", "_found", "_map", "_rank", "_spans", "c0", "c1", "a.b", "number", "rank", "row", "surrogate", "h1", "kind", "unit"]
    df = spark.createDataFrame([(i, f"{line}\nMr. Jonas Kraft {i}", *[i] * len(names)) for i in range(3)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = pii_surrogates.replace_entities(df, pii_surrogates.Surrogates("k"))
    assert out.columns == [*df.columns, "n_entities", "kinds"] and all(r["_map"] == r.doc_id and "Kraft" not in r.text for r in out.collect())
    out = line_dedup.deduplicated(df)
    assert out.columns == [*df.columns, "n_units", "n_removed", "removed"] and {r.doc_id: r.n_removed for r in out.collect()} == {0: 0, 1: 1, 2: 1}
    again = line_dedup.deduplicated(pii_surrogates.replace_entities(out, pii_surrogates.Surrogates("k")))
    assert again.count() == 3
    kept = cp.drop_near_duplicates(spark, df, "").collect()
    assert [r.doc_id for r in kept] == [0] and cp.drop_near_duplicates(spark, df, "").columns == df.columns


def test_rows_without_an_id_of_their_own(spark):
    words = lambda k: " ".join(f"word{k}x{i}" for i in range(40))
    rows = [(None, words(1)), (None, words(1)), (None, words(1)), (5, words(2)), (5, words(2)), (6, words(3)), (6, words(4)), (9, words(4)), (2, words(1)), (7, None), (7, None), (8, ""), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, df, "").collect()), key=str)
    assert got == sorted([(5, words(2)), (6, words(3)), (6, words(4)), (None, words(1)), (7, None), (7, None), (8, ""), (None, "")], key=str)


def test_equal_rows_are_no_bucket(spark):
    df = spark.range(0, 60_000, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    out = sharding.shards(df, sharding.Sharding(shards=4, bucket_rows=2_000))
    assert {(r["shard"], r["n"], r["last"]) for r in out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()} == {(k, 15_000, 14_999) for k in range(4)}
    base = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("crc"), F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), F.lit(1).alias("size"), F.lit(None).cast("long").alias("members"), F.lit(False).alias("linked"), F.lit(0).alias("home"), F.col("id").alias("number"))
    ranks = sharding._numbered(base, sharding.Sharding(shards=4, bucket_rows=2_000), 60_000)
    assert ranks.agg(F.count_distinct("rank").alias("n"), F.max("rank").alias("m")).first() == (60_000, 59_999)


def test_batches_shrink_with_languages(monkeypatch):
    asked = []
    real = language_id.by_length
    monkeypatch.setattr(language_id, "by_length", lambda words, most=20_000: asked.append(most) or real(words, most))
    v = language_id.vocabulary(language_id.LanguageId().vocabulary)
    import numpy as np

    for n in (4, 200):
        language_id.log_probabilities(["word", "text"], v, np.full((n, v.size + 1), 1 / (v.size + 1)))
    assert asked == [20_000, 400]


def test_short_lines_go_where_they_are_boilerplate(spark):
    line = "A short line in many texts."
    rows = [(i, f"Head {i} with its own few words.\n{line}\nrare line of two texts{i // 2}\nyes no") for i in range(40)]
    df = spark.createDataFrame([*rows, (99, None)], "doc_id long, text string")
    assert all(r.text == dict(rows).get(r.doc_id) for r in line_dedup.deduplicated(df).collect())
    got = {r.doc_id: r for r in line_dedup.deduplicated(df, line_dedup.Units(often=0.5)).collect()}
    assert sum(line in (r.text or "") for r in got.values()) == 1 and line in got[0].text and got[99].text is None
    assert all(got[i].text == t.replace(line + "\n", "") and got[i].n_removed == 1 for i, t in rows[1:])
    none = {r.doc_id: r.n_removed for r in line_dedup.deduplicated(df, line_dedup.Units(often=1.0)).collect()}
    assert not any(none.values())


def test_templates_from_a_table_of_license_texts(spark):
    text = "Permission is granted to anyone to use this software for any purpose. Short one.\n\nThe origin of this software must not be misrepresented; you must not claim that you wrote the original software:"
    table = spark.createDataFrame([("zlib", text), ("zlib", text), (None, text), ("none", None)], "label string, text string")
    notices = license_scan.notices_from(table)
    assert [n for n, _ in notices] == ["zlib"] * 3 and ("zlib", "permission is granted to anyone to use this software for any purpose") in notices
    assert all(8 <= len(n.split()) <= 9 for _, n in license_scan.notices_from(table, longest=9))
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "permission to use anything else is not granted")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.summary(license_scan.scan(docs, license_scan.Scan(notices=notices))).collect()}
    assert got == {1: "zlib", 2: ""}
