"""The dealt operators against brute force, on a small fixture with the edge cases and on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import chat, decontam, langid, media, near_dups, packing, quality, substring, token_ids, tokens
from touchline.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, score string, n string"
WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(WORDS, 120)) for _ in range(6)]
    texts = [None, "", "   ", "a", "A b", "one two three", *base, base[0], base[0].replace("w1 ", "w2 ", 1), base[1] + " tail", "x<|endoftext|>y  <|endoftext|>", "né ▁ \n\n z\t日本", " ".join(rng.choice(WORDS, 60_000))]
    for k in range(40):  # a group of near copies
        w = base[2].split()
        for at in rng.choice(120, k % 5, replace=False):
            w[at] = f"q{rng.integers(50)}"
        texts.append(" ".join(w))
    return [(i, t, "en", "clash", "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(rows, k, percent):
    sets = [shingles(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for j, c in Counter(j for x in s for j in where.get(x, ())).items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for x in s:
            where.setdefault(x, []).append(i)
    return {r[0]: (len(sets[i]), rows[find(i)][0]) for i, r in enumerate(rows)}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_dups(docs, rows, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(docs, near_dups.Plan(k, percent)).collect()}
    assert got == groups(rows, k, percent)


def test_near_dups_second_round_finds_what_stars_miss(spark, docs, rows):
    """All pairs of the prefix filter's answer hold every link between members that stars left apart."""
    plan = near_dups.Plan(3, 85)
    own = docs.where("doc_id >= 18").select("doc_id", "text")
    ids = [r[0] for r in rows if r[0] >= 18]
    texts = dict((r[0], r[1]) for r in rows)
    keys = spark.createDataFrame([(1, 0, 1, i) for i in ids], "key long, pivot long, other long, doc_id long")
    sizes = spark.createDataFrame([(i, len(shingles(texts[i], 3))) for i in ids], "doc_id long, n long")
    none = spark.createDataFrame([], "node long, root long")
    got = {(r.a, r.b) for r in near_dups.undecided(keys, none, own, sizes, plan).collect()}
    for i in ids:
        for j in ids:
            a, b = shingles(texts[i], 3), shingles(texts[j], 3)
            main = max(ids)  # all roots have one member; the largest counts as the main one
            if i < j and main not in (i, j) and 100 * len(a & b) >= 85 * len(a | b):
                assert (i, j) in got


def test_tokens_ids_packing(spark, docs, rows):
    import sentencepiece
    from tokenizers import Tokenizer

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(tokens.MODEL))
    tk = Tokenizer.from_file(tokenizer_path(token_ids.MODEL))
    got = {r.doc_id: r for r in tokens.token_counts(docs).collect()}
    ids = {r[0]: tk.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    for i, text, *_ in rows:
        assert got[i].n_tokens == len(sp.encode(text or "")) and got[i].n_bytes == len((text or "").encode())
    start = 0
    for r in sorted(token_ids.token_ids(docs, shard_ids=3000).collect(), key=lambda r: r.doc_id):
        own = np.array([*ids[r.doc_id], 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    pieces = packing.pack_documents(docs).collect()
    assert sum(p.length for p in pieces) == sum(len(x) + 1 for x in ids.values())
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
        own = np.array([*ids[p.doc_id], 0], "<u4")[p.start : p.start + p.length]
        assert zlib.crc32(own.tobytes()) == p.ids_crc32
    for ps in by.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == np.cumsum([0, *[p.length for p in ps][:-1]]).tolist() and sum(p.length for p in ps) <= 2048
    assert len(by) <= -(-sum(p.length for p in pieces) // 2048) + 1


def test_chunk_maps_compose():
    import sentencepiece

    from touchline.llm.transducer import transducer

    machine = transducer(tokenizer_path(tokens.MODEL))
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(tokens.MODEL))
    rng = np.random.default_rng(4)
    letters = list("abcdetinosr  \u2581\n.,'\u00e9\u65e5\u0444\U0001f600\0\tABC123____===---   ")
    pieces = [library.id_to_piece(int(k)).replace("\u2581", " ") for k in rng.integers(259, 32000, 3000)]
    texts = ["", "Ab  c\n\nd e\u2581f" * 3 + "\n x y\u00e9 \u65e5\u672c", "<s> </s> <unk> <0x0A>", " " * 70 + "a", "=" * 90, "a" * 3000]
    texts += ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice(pieces, rng.integers(1, 12))) for _ in range(1500)]
    want = [len(library.encode(t)) for t in texts]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for chunk in (3, 64, tokens.CHUNK):
        assert tokens.counts(machine, data, offsets, chunk=chunk).tolist() == want
    # a chunk's map does not depend on how chunks are grouped, and from every state it ends where its symbols lead
    one = np.frombuffer(texts[1].encode(), np.uint8)
    symbol, places = tokens.symbols_of(machine, one, np.array([0, len(one)]))
    state, total = 0, 0
    for x, y in zip([0, *symbol[:-1]], symbol, strict=True):
        if not machine.near[x, y]:
            state = 0
        what, made = machine.step(state, int(y))
        state, total = machine._state(what), total + made
    assert total == want[1]


def test_transducer_starts_anew_when_full():
    from touchline.llm.transducer import Transducer, transducer

    whole = transducer(tokenizer_path(tokens.MODEL))
    small = Transducer(whole.score, slots=1 << 12)
    rng = np.random.default_rng(2)
    for _ in range(3):
        raw = [" ".join("".join(rng.choice(list("aeinrst"), 5)) for _ in range(60)).encode()]
        data, offsets = np.frombuffer(raw[0], np.uint8), np.array([0, len(raw[0])])
        assert tokens.counts(small, data, offsets) == tokens.counts(whole, data, offsets)
    assert small.held < 1 << 12


def test_packed_blocks():
    for n in (0, 1, 1023, 1024, 5000):
        ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
        assert (token_ids.unpack(token_ids.pack(ids)) == ids).all()


def test_media(docs, rows):
    got = {r.doc_id: r for r in media.media_digests(docs).collect()}
    for i, text, *_ in rows:
        raw = (text or "").encode()
        pad = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert got[i].payload_sha256 == hashlib.sha256(pad).hexdigest() and got[i].tail_crc32 == zlib.crc32(pad[-16:]) and got[i].n_bytes == len(raw)
        assert got[i].media_sha256 == hashlib.sha256(media.to_wav(pad)).hexdigest()
    assert got[6].feature == got[12].feature and media.from_wav(media.to_wav(b"abc"))[0] == b"abc"
    assert media.media_digests(docs.limit(0)).count() == 0
    twice = media.media_digests(docs.where("doc_id = 7").union(docs.where("doc_id = 7"))).collect()
    assert len(twice) == 2 and twice[0] == twice[1] == got[7]


def plain_features(samples: bytes):
    """Resampled clip, log-mel energies of each frame and its active frames, by the definitions, one number at a time where cheap."""
    x = (np.frombuffer(samples, np.uint8) - np.float64(np.frombuffer(samples, np.uint8).mean())) / 128
    n, taps, down = len(x), media.TAPS * media.DOWN, media.DOWN
    t = np.arange(taps) - (taps - 1) / 2
    low = np.sinc(t / down) * np.hamming(taps) / down
    low /= low.sum()
    frames = max(1, -(-(-(-n // down) - media.WINDOW) // media.HOP) + 1)
    total = (frames - 1) * media.HOP + media.WINDOW
    y = np.zeros(total)
    for m in range(total):
        at = m * down - taps // 2 + np.arange(taps)
        ok = (at >= 0) & (at < n)
        y[m] = (low[::-1][ok] * x[at[ok]]).sum()  # the filter is symmetric
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(media.RATE / down / 2), media.MELS + 2) / 2595) - 1)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(media.WINDOW // 2 + 1), np.arange(media.WINDOW)) / media.WINDOW)
    out, loud = [], []
    for k in range(frames):
        cut = y[k * media.HOP : k * media.HOP + media.WINDOW]
        power = np.abs(turn @ (cut * np.hanning(media.WINDOW))) ** 2
        row = []
        for a, b, c in zip(edges, edges[1:], edges[2:], strict=False):
            f = np.arange(len(power)) * (media.RATE / down) / media.WINDOW
            rise, fall = (f - a) / (b - a), (c - f) / (c - b)
            row.append(np.log(sum(p * max(0, min(r, s)) for p, r, s in zip(power, rise, fall, strict=True)) + 1e-6))
        out.append(row)
        loud.append(np.sqrt((cut**2).mean()))
    level, on, busy = np.sqrt((np.array(loud) ** 2).mean()), False, []
    for v in loud:
        on = level >= media.SILENT and (v >= media.LOUD * level or (on and v >= media.QUIET * level))
        busy.append(on)
    return np.array(out), busy


def test_media_features_against_a_plain_version(spark, tmp_path):
    rng = np.random.default_rng(6)
    tone = lambda level, n: bytes(128 + round(128 * level * np.sin(k / 3)) for k in range(n))
    step = media.HOP * media.DOWN
    clips = {1: bytes(rng.integers(0, 256, 900, dtype=np.uint8)), 2: tone(0.5, 3 * step) + tone(0.28, 20 * step) + tone(0.05, 20 * step) + tone(0.5, 2 * step), 3: b"so few words " * 50, 4: b" " * 192}
    frame = spark.createDataFrame([(k, len(v), bytearray(media.to_wav(v))) for k, v in clips.items()] + [(9, 0, None)], media.CLIPS)
    media.write_features(frame, str(tmp_path / "features"))
    made = media.read_features(spark, str(tmp_path / "features")).collect()
    assert {r.doc_id for r in made} == set(clips)
    seconds = step / media.RATE
    for k, samples in clips.items():
        own = sorted((r for r in made if r.doc_id == k), key=lambda r: r.block)
        assert all(r.shape == [media.FRAMES, media.MELS] and len(r.mel) == media.FRAMES * media.MELS for r in own)
        sizes = [round((r.end_s - r.start_s) / seconds) for r in own]
        mel = np.concatenate([np.array(r.mel).reshape(media.FRAMES, media.MELS)[:n] for r, n in zip(own, sizes, strict=True)])
        want, busy = plain_features(samples)
        assert mel.shape == want.shape and np.abs(mel - want).max() < 2e-2
        on = [any(s.from_s <= i * seconds + 1e-9 and (i + 1) * seconds <= s.to_s + 1e-9 for s in own[0].active) for i in range(len(busy))]
        assert on == busy
    assert sum(a != b for a, b in zip([False, *plain_features(clips[2])[1]], plain_features(clips[2])[1], strict=False)) >= 3


def test_chat(spark):
    rows = [(1, 1, "assistant", "x<|im_end|>\\\n<\\."), (1, 0, "user", None), (2, 0, "assistant", "first"), (3, None, None, ""), (None, 0, "user", "n"), (4, 0, "user\n", "a\n"), *[(5, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(200)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", ""), ("assistant", "x<|im_end|>\\\n<\\.")] and got[1].loss_text == "x<|im_end|>\\\n<\\."
    assert got[1].valid and not got[2].valid and not got[3].valid and got[None].valid and got[5].valid
    assert [tuple(t) for t in got[4].turns] == [("user\n", "a\n")] and got[5].n_turns == 200 and got[5].loss_text == "".join(f"t{k}" for k in range(1, 200, 2))
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_decontamination(spark, docs, rows):
    bench = [(1, " ".join((rows[7][1]).split()[5:25])), (2, "one two"), (3, None), (4, "!!"), (5, "ABSENT words here")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in bench:
        w = cut(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    got = {r.doc_id: r for r in decontam.contamination(docs, b).collect()}
    for i, text, *_ in rows:
        w, hit, items = cut(text), set(), set()
        for size in {len(x) for x in wins}:
            for p in range(len(w) - size + 1):
                if x := wins.get(tuple(w[p : p + size])):
                    hit |= set(range(p, p + size))
                    items |= x
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (len(w), len(hit), len(items), bool(hit))
        assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in decontam.decontaminate(docs, b).collect()}
    assert clean[8] == rows[8][1] and not set(cut(rows[7][1])[5:25]) <= set() and cut(clean[7]) == cut(rows[7][1])[:5] + cut(rows[7][1])[25:]
    assert decontam.contamination(docs, b.limit(0)).where("contaminated").count() == 0


def test_repeats(spark):
    rng = np.random.default_rng(5)
    said = lambda n: " ".join(" ".join(rng.choice(WORDS, 9)).capitalize() + "." for _ in range(n))
    passage = said(7)
    rows = [(1, said(3) + "\n" + passage + "\n" + said(2)), (2, said(4) + "\n" + passage), (3, said(6)), (4, None), (5, ""), (6, passage), (7, "Hi. Hi. Hi. Hi."), (8, "Hi. Hi. Hi. Hi.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1))
    got = {r.doc_id: r for r in substring.remove_repeats(df).collect()}
    want = dict(rows)
    assert all(got[k].text == want[k] for k in (1, 3, 4, 5, 7, 8))
    assert got[2].text.strip() == want[2][: -len(passage)].strip() and got[6].text == "" and got[2].n_removed == 7
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_repeats_against_brute_force(spark, small):
    said = " ".join(WORDS[k % len(WORDS)] for k in range(18)).capitalize() + ". "
    mine = [(-3, said * 4), (-2, "Own words here. " + said + "More own words. " + said * 2), (-1, said), (-1, said)]
    rows = mine + [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    found, seen = {}, {}
    for k, (i, text) in enumerate(rows):
        data = np.frombuffer((text or "").encode(), np.uint8)
        for _, s, n, h, g in zip(*substring.spans(data, np.array([0, len(data)]), substring.MIN_WORDS), strict=True):
            found.setdefault(k, []).append(((h, g), s, n))
            seen[h, g] = min(seen.get((h, g), (i, s)), (i, s))
    want = []
    for k, (i, text) in enumerate(rows):
        gone = {x for h, s, n in found.get(k, []) if seen[h] != (i, s) for x in range(s, s + n)}
        data = np.frombuffer((text or "").encode(), np.uint8)
        bounds = [*substring.sentence_bounds(data, np.array([0, len(data)]))[0], len(data)]
        left = b"".join(data[a:b].tobytes() for x, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if x not in gone).decode()
        want.append((i, None if text is None else left, len(gone)))
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (r[0], r[1] or "", r[2])
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got), key=key) == sorted(want, key=key)
    assert sum(n for i, _, n in want if i == -3) == 3


def test_repeats_in_other_scripts(spark):
    rng = np.random.default_rng(8)
    made = lambda lo, hi, n: "".join(chr(c) for c in rng.integers(lo, hi, n))
    chinese = lambda n: "".join(made(0x4E00, 0x9000, 20) + "\u3002" for _ in range(n))
    thai = lambda n: " ".join(made(0x0E01, 0x0E2E, 30) for _ in range(n)) + " "
    quoted = lambda n: " ".join('He said "' + " ".join(rng.choice(WORDS, 9)) + '."' for _ in range(n)) + " "
    rows, want, key = [], {}, 0
    for some in (chinese, thai, quoted):
        passage, own = some(6), [some(3) for _ in range(4)]
        for text, left in ((own[0] + passage + own[1], None), (own[2] + passage + own[3], own[2] + own[3])):
            rows.append((key, text))
            want[key] = left or text
            key += 1
    rows += [(100, "\u4f60\u597d\u3002" * 3), (101, "\u4f60\u597d\u3002" * 3)]  # short repeated lines stay
    got = {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in want.items():
        assert got[k].text == text, k
    assert all(got[k].n_removed == 6 for k in (1, 3, 5)) and got[1].removed_words == 6 * 7 and got[5].removed_words == 6 * 11 and got[101].n_removed == 0
    text = np.frombuffer(b"Ends. next", np.uint8)  # a row's sentences do not depend on the row before it
    assert (substring.sentence_bounds(text, np.array([0, 5, 10]))[0] == [0, 5]).all()


def test_language(spark, small):
    docs = spark.read.parquet(f"{small}/../sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.95
    odd = spark.createDataFrame([(1, None, None), (2, "12 !!", "en"), (3, "", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(odd, langid.train(docs)).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_quality(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert got > 0.93
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.classify(docs.limit(3), labels.limit(0)).where("score between 0 and 1").count() == 3


def test_quality_with_few_labels(spark, small, tmp_path):
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{small}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    few = labels.where("quality = 1").orderBy("doc_id").limit(6).union(labels.where("quality = 0").orderBy("doc_id").limit(6))
    model = quality.train(docs, few)
    assert model.net is not None and quality.scored(docs, model).agg(F.countDistinct("score")).first()[0] > 100
    assert quality.train(docs, labels.where("quality = 1").limit(1).union(labels.where("quality = 0").limit(1))).net is not None
    for some in (labels.limit(0), labels.where("quality = 1"), labels.where("quality = 0")):
        assert quality.classify(docs.limit(5), some).where("predicted = 1").count() == 5
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).count() == docs.count()


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = near_dups.written(stage(spark, docs, small), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    assert near_dups.near_duplicates(docs.where("doc_id < 0")).count() == 0
