"""Edge cases of the dealt operators and plain versions of what SQL cannot express."""

import re

import numpy as np
from pyspark.sql import functions as F

from touchline.llm import chat, decontam, langid, media, near_dups, packing, quality, substring, token_ids, tokens

TEXTS = "doc_id long, text string"


def said(rng, n, words=9, pool=400):
    return " ".join(" ".join(f"w{k}" for k in rng.integers(0, pool, words)).capitalize() + "." for _ in range(n))


def test_empty_tables_and_repeated_rows(spark):
    rows = [(1, "a few words here"), (1, "a few words here"), (2, None), (2, None), (3, ""), (None, "no id at all")]
    df = spark.createDataFrame(rows, TEXTS)
    made = {"tokens": tokens.token_counts, "ids": token_ids.token_ids, "pack": packing.pack_documents, "media": media.media_digests}
    for name, work in made.items():
        assert work(df.limit(0)).count() == 0, name
        if name != "ids":
            got = work(df.where("doc_id is not null")).collect()
            assert len(got) == 5, name
    ids = token_ids.token_ids(df.where("doc_id is not null")).orderBy("doc_id", "start").collect()
    assert [r.n_tokens for r in ids] == [ids[0].n_tokens] * 2 + [1, 1, 1] and [r.start for r in ids] == np.cumsum([0, *[r.n_tokens for r in ids]])[:-1].tolist()
    assert tokens.token_counts(df).count() == 6


def test_chat_ties_repeats_and_long_texts(spark):
    long = "y<|im_end|>" * 50_000
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s"), (2, 0, "user", "q"), (2, 1, "assistant", long)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[2].loss_text == long and got[2].valid


def test_family_below_the_threshold_of_one_component(spark, monkeypatch):
    """Open pairs of families whose members differ in four random words each do not grow with the square."""
    seen = []
    plain = near_dups.undecided

    def counted(*args):
        made = near_dups.written(plain(*args), "counted")
        seen.append(made.count())
        return made

    monkeypatch.setattr(near_dups, "undecided", counted)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 5000, 270)]
    for g in (200, 400):
        rows = []
        for i in range(g):
            w = list(base)
            for at in rng.choice(len(w), 4, replace=False):
                w[at] = f"q{rng.integers(10**9)}"
            rows.append((i, " ".join(w)))
        assert near_dups.near_duplicates(spark.createDataFrame(rows, TEXTS), near_dups.Plan(3, 85)).where("kept").count() == 1
    assert all(n <= 20 * g for n, g in zip(seen, (200, 400), strict=True))


def test_near_dups_repeated_and_missing_ids(spark):
    rng = np.random.default_rng(2)
    a, b = said(rng, 6), said(rng, 6)
    rows = [(5, a), (5, a), (3, a), (7, b), (None, said(rng, 5)), (8, None)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, TEXTS), near_dups.Plan(3, 85)).collect()
    assert len(got) == 6 and sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(3, 3), (5, 3), (5, 3), (7, 7), (8, 8)]


def test_decontamination_clashes_repeats_and_wide_benchmarks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    item = " ".join(f"b{k}" for k in rng.integers(0, 90, 25))
    rows = [(1, "Start here, " + item + " and end."), (1, "One id, another text."), (1, "Start here, " + item + " and end."), (None, item), (None, None), (2, ""), (3, "tiny one, nothing else")]
    names = ["hit_words", "hit_id", "hit_at", "items", "row", "own", "id_part", "text_part", "w", "k"]
    docs = spark.createDataFrame(rows, TEXTS).withColumns({c: F.lit(c) for c in names})
    bench = spark.createDataFrame([("x", item), ("y", "Tiny one"), ("z", None), ("same stem", item), (None, "!!")], "item_id string, text string")
    for limit in (decontam.BROADCAST_BYTES, 0):
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
        got = decontam.contamination(docs, bench).collect()
        assert len(got) == len(rows) and sorted((r.n_words, r.n_hit, r.n_items) for r in got) == [(0, 0, 0), (0, 0, 0), (4, 0, 0), (4, 2, 1), (25, 25, 2), (29, 25, 2), (29, 25, 2)]
        clean = decontam.decontaminate(docs, bench).collect()
        assert sorted((r.text or "") for r in clean) == ["", "", ", nothing else", "One id, another text.", "Start here and end.", "Start here and end."]
        assert len(clean) == 6 and all(r[c] == c for r in clean for c in names)
        assert decontam.decontaminate(docs, bench, drop=True).count() == 3
        assert decontam.contamination(docs.limit(0), bench).count() == 0 and decontam.decontaminate(docs.limit(0), bench).count() == 0
        assert decontam.decontaminate(docs, bench.limit(0)).count() == len(rows)


def plain_cut(rows, least):
    """Repeated spans of ASCII texts removed, without the operator's code: regular expressions, tuples of words, a dictionary."""
    split = [re.findall(r".+?(?:[.!?]+[\"')\]}]*\s+|\s*\n\s*|$)", t or "", re.S) for _, t in rows]
    words = [[tuple(s.split()) for s in x] for x in split]
    first, spans = {}, []
    for k, (i, _) in enumerate(rows):
        own = set()
        for a in range(len(words[k])):
            for b in range(a + 2, len(words[k]) + 1):
                if sum(map(len, words[k][a:b])) >= least:
                    own.add((a, b))
                    break
        for b in range(len(words[k]), 1, -1):
            for a in range(b - 2, -1, -1):
                if sum(map(len, words[k][a:b])) >= least:
                    own.add((a, b))
                    break
        spans.append(own)
        for a, b in own:
            what = tuple(words[k][a:b])
            first[what] = min(first.get(what, (i, a)), (i, a))
    out = []
    for k, (i, t) in enumerate(rows):
        gone = {x for a, b in spans[k] if first[tuple(words[k][a:b])] != (i, a) for x in range(a, b)}
        out.append((i, t if not gone else "".join(s for x, s in enumerate(split[k]) if x not in gone), len(gone)))
    return out


def test_repeats_against_an_independent_version(spark):
    rng = np.random.default_rng(9)
    passages = [said(rng, n, m) for n, m in ((3, 9), (2, 8), (2, 7), (5, 4), (1, 30), (6, 2))]
    rows = []
    for i in range(60):
        parts = [said(rng, int(rng.integers(1, 4)), int(rng.integers(2, 12)))]
        for k in rng.choice(len(passages), rng.integers(0, 3)):
            parts += [passages[k], said(rng, 1, 5)]
        if i % 7 == 0:
            parts += [parts[-1]] * 3
        rows.append((i, (" " if i % 2 else "\n").join(parts)))
    rows += [(100, None), (101, ""), (102, "One. Two. Three.")]
    names = ["cut_at", "cut_id", "cut_text", "h", "s", "n", "more", "t", "first"]
    docs = spark.createDataFrame(rows, TEXTS).withColumns({c: F.lit(c) for c in names})
    got = substring.remove_repeats(docs).collect()
    assert all(r[c] == c for r in got for c in names)
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got if r.text is not None) == sorted(x for x in plain_cut(rows, substring.MIN_WORDS) if x[1] is not None)
    assert sum(r.n_removed for r in got) > 50


def test_repeats_of_one_id_with_two_texts(spark):
    rng = np.random.default_rng(10)
    p, a, b = said(rng, 5), said(rng, 3), said(rng, 1)
    rows = [(1, p), (2, a + " " + p), (2, b + " " + p), (None, p)]
    got = sorted((r.doc_id or 0, r.text.strip()) for r in substring.remove_repeats(spark.createDataFrame(rows, TEXTS)).collect())
    assert got == sorted([(0, p), (1, ""), (2, a), (2, b)])


def test_language_kernel_against_sets():
    rng = np.random.default_rng(5)
    texts = [("".join(rng.choice(list("abcdefg" if k % 2 else "efghijk"), 30))) for k in range(40)]
    raw = [t.encode() for t in texts]
    bits = langid.presence(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    model = langid.fit(np.packbits(bits, axis=1), ["odd" if k % 2 else "even" for k in range(40)], landmarks=6)

    def grams(r):
        pairs = {("p", r[i] << 8 | r[i + 1]) for i in range(len(r) - 1)}
        return pairs | {("t", (((r[i] << 16 | r[i + 1] << 8 | r[i + 2]) * 2654435761) % 2**32) >> 16) for i in range(len(r) - 2)}

    marks = [k for k in range(40) if k % 2 == 0][:6] + [k for k in range(40) if k % 2][:6]
    marks.sort()
    kernel = np.array([[len(grams(raw[i]) & grams(raw[j])) / np.sqrt(len(grams(raw[i])) * len(grams(raw[j]))) for j in marks] for i in range(40)])
    value, vector = np.linalg.eigh(kernel[marks])
    x = kernel @ (vector / np.sqrt(value))
    y = np.where(np.array([k % 2 for k in range(40)])[:, None] == [0, 1], 1.0, -1.0)
    mean = x.mean(axis=0)
    w = np.linalg.solve((x - mean).T @ (x - mean) + langid.RIDGE * np.eye(12), (x - mean).T @ (y - y.mean(axis=0)))
    want = (x - mean) @ w + y.mean(axis=0)
    assert np.abs(model.scores(bits) - want).max() < 1e-3


def test_every_language_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(k * 10 + r if k else None, f"{a}{b}{a}{a}{b} {b}{b}{a}" * 6, f"lang{k:03}") for k, (a, b) in enumerate((a, b) for a in letters for b in letters[:9]) for r in range(3)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 26 * 9
    clash = spark.createDataFrame(rows[:30], "doc_id long, text string, lang string").withColumns({c: F.lit(c) for c in ("lang_pred", "score", "place", "id", "own", "rn", "held_out")})
    assert langid.identify(clash).count() == 30 and langid.identify(clash.union(clash)).distinct().count() <= 30


def test_quality_network_by_hand_and_clashes(spark):
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(60, 5)), np.arange(60) % 2
    net = quality.fit(x, y)
    want = []
    for row in x:
        hidden = [np.tanh(sum((row[i] - net.mean[i]) / net.scale[i] * net.w1[i, j] for i in range(5)) + net.b1[j]) for j in range(quality.HIDDEN)]
        want.append(1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2) / net.heat)))
    assert np.abs(net.score(x) - want).max() < 1e-8
    rows = [(k, ("good calm words in order " if k % 2 else "!!! $$ 77 buy ") * (1 + k % 5)) for k in range(80)] + [(90, None), (91, ""), (92, "x" * 100_000), (3, "good calm words in order ")]
    docs = spark.createDataFrame(rows, TEXTS).withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = quality.scored(docs, quality.train(docs, labels), "quality_score")
    assert kept.columns == ["doc_id", "text", "score", "quality_score"] and {r.score for r in kept.collect()} == {"mine"}


def test_word_vectors_against_a_plain_count(spark):
    rows = [(1, "a b c a"), (2, "b c"), (3, None)]
    made = quality.word_vectors(spark.createDataFrame(rows, TEXTS).repartition(2))
    index = quality.index_vectors()
    bucket = lambda w: int(quality.bucket_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0])
    want = {}
    for _, text in rows:
        w = (text or "").split()
        for i in range(len(w)):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if i != j:
                    want[w[i]] = want.get(w[i], 0) + index[bucket(w[j])].astype(int)
    for w, v in want.items():
        assert np.abs(made[bucket(w)] - v / max(np.linalg.norm(v), 1)).max() < 1e-6


def test_pipeline_run(spark, tmp_path):
    """The whole pipeline over small tables with every kind of row that it has to handle."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from touchline.llm.common import tokenizer_path

    rng = np.random.default_rng(13)
    passage, item = said(rng, 7), " ".join(f"b{k}" for k in rng.integers(0, 90, 25))
    rows = [(k, said(rng, 12), "en") for k in range(40)]
    rows += [(100 + k, "$$ 11 !! ## " * 20, "xx") for k in range(20)]
    rows += [(200, rows[0][1], "en"), (201, rows[1][1] + " " + passage, "en"), (202, rows[2][1] + " " + said(rng, 9) + " " + passage, "en"), (203, rows[3][1] + " " + said(rng, 9) + " " + item, "en"), (204, None, None), (205, "", "en"), (206, item, "en")]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows, schema).withColumns({"n_chars": F.length("text"), **{c: F.lit(c) for c in ("score", "n_removed", "hit_at", "cut_at", "kept")}})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1) for k in range(40)] + [(100 + k, 0) for k in range(20)] + [(204, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left, step = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = near_dups.written(stage(spark, left, str(tmp_path)), name)
        assert left.columns == docs.columns and all(r[c] == c for r in left.collect() for c in ("score", "n_removed", "hit_at", "cut_at", "kept"))
        step[name] = {r.doc_id: r.text for r in left.collect()}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert not set(step["quality_classifier"]) & set(range(100, 120)) and set(range(40)) <= set(step["quality_classifier"])
    assert 200 not in step["near_dedup"] and set(range(40)) <= set(step["near_dedup"])
    cut = step["substring_dedup"]
    assert passage in (cut.get(201) or "") and passage not in (cut.get(202) or "") and cut[5] == rows[5][1]
    assert item not in (step["decontamination"].get(203) or "") and 206 not in step["decontamination"] and step["decontamination"][7] == rows[7][1]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(tokenizer_path(packing.MODEL))
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in step["decontamination"].items()}
    assert {p.doc_id for p in pieces} == set(want) and all(p.ids == want[p.doc_id][p.start : p.start + p.length] for p in pieces)
    by = {}
    for p in sorted(pieces, key=lambda p: p.offset):
        assert p.offset == by.get(p.sequence_id, 0)
        by[p.sequence_id] = p.offset + p.length
    assert max(by.values()) <= packing.CAPACITY
