"""Bounds that hold whatever the rows: tables that start anew within a text, samples that repeated rows cannot crowd out."""

import random

import sentencepiece
from pyspark.sql import functions as F

from touchline.llm import langid, quality, tokens
from touchline.llm.common import has_letter, tokenizer_path
from touchline.llm.transducer import Transducer


def test_table_starts_anew_within_one_long_text():
    import numpy as np

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(tokens.MODEL))
    plain = [k for k in range(model.get_piece_size()) if not (model.is_unknown(k) or model.is_control(k) or model.is_byte(k) or model.is_unused(k))]
    machine = Transducer({model.id_to_piece(k): model.get_score(k) for k in plain}, slots=4096)
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/", k=n)) for n in (20_000, 3, 60_000)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    for chunk in (512, 40):
        got = tokens.counts(machine, data, np.cumsum([0, *map(len, texts)]), chunk)
        assert got.tolist() == [len(model.encode(t)) for t in texts]


def test_letters_are_not_numerals(spark):
    assert [has_letter(t) for t in ("½ ²", "Ⅷ 一", "12 _", "١٢", "é", "ª")] == [False, True, False, False, True, True]
    rows = [(k, f"the words of a language number {k} and more" if k % 2 else f"les mots de la langue numéro {k} et plus", "en" if k % 2 else "fr") for k in range(60)]
    df = spark.createDataFrame([*rows, (100, "½ ²", None), (101, "Ⅷ ⅓", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).where("doc_id >= 100").collect()}
    assert [(got[k].lang_pred, got[k].score) for k in (100, 101)] == [("und", 0.0)] * 2


def test_repeated_rows_do_not_crowd_the_language_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "fit", lambda packed, langs, *a: seen.append(langs))
    rows = [(k, f"mots de la langue {k}", "fr") for k in range(700)] + [(1000 + k, f"words {k} of it", "en") for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first = df.where("lang = 'fr'").orderBy(F.xxhash64(F.col("doc_id").cast("string"))).head()
    copies = spark.range(1000).select(F.lit(first.doc_id).alias("doc_id"), F.lit(first.text).alias("text"), F.lit("fr").alias("lang"))
    langid.train(df.union(copies).union(spark.createDataFrame([(None, "sans nom", "fr")], df.schema)), 600)
    assert seen[0].count("fr") == seen[0].count("en") == 600


def test_quality_learns_from_one_row_an_id(spark, monkeypatch):
    seen = []
    plain = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, *a: seen.append(len(y)) or plain(x, y, *a))
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text"))
    docs = docs.crossJoin(spark.range(300).select(F.col("id").alias("copy"))).drop("copy")
    labels = spark.range(20).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    quality.train(docs, labels)
    assert seen == [20]
