"""Operators 11 to 13 against plain versions: page text, turn repair, alignment of two tokenizers."""

import hashlib
import html
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import crossalign, pagetext, turnrepair
from touchline.llm.common import tokenizer_path
from touchline.llm.layouts import draw


@pytest.fixture(scope="module")
def labeller():
    return pagetext.trained()


def test_page_text_of_the_given_pages(spark, small, labeller):
    rows = pagetext.extract(spark.read.parquet(f"{small}/pages.parquet"), labeller).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S).group(1)
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split()) and r.n_chars == len(r.text)


def test_page_layouts_not_seen_in_training(labeller):
    x, y = pagetext.labelled([draw(np.random.default_rng(seed), pagetext.MARK) for seed in range(1000, 1200)])
    assert ((labeller.logits(x) > 0) == (y > 0.5)).mean() > 0.98


def test_page_reader():
    def texts(page):
        return [b.text for b in pagetext.blocks(page)[0]]

    assert texts("a &lt;b&gt; &amp c &am <b>d</b>e<p>f<p>g\n\t h&nbsp;i") == ["a <b> & c &am de", "f", "g h i"]
    assert texts("1 < 2 <3> <!-- x <p> --> y<!--> z <script>a</p>'<p>'</script>w") == ["1 < 2 <3> y z w"]
    assert texts("a<div title='>' class=\"x'\">b</div>c<style>p{}</style><!-- never closed <p>d") == ["a", "b", "c"]
    assert texts("a<b title=\"no end>b<p>c") == ["ab", "c"] and texts("a<script>b") == ["a"] and texts("a<br") == ["a"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul>d<title>t</title>") == ["a", "b", "c", "d"] and texts("") == [] and texts(" <p> </p>") == []
    made, paths = pagetext.blocks('<body><div id=mainText class="Side-bar"><p><b>x</b></div>y')
    assert [paths[b.path][1] for b in made] == [("b",), ("body",)] and paths[paths[made[0].path][0]][1] == ("p",)
    assert (".main", ".text", ".side", ".bar") == tuple(sorted(paths[2][1][1:], key=[".main", ".text", ".side", ".bar"].index))
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert texts(deep) == ["x"] and len(pagetext.numbered([pagetext.blocks(deep)]).path) > 0


def test_page_labels_do_not_depend_on_neighbours_and_gradients_are_right(labeller):
    read = [pagetext.blocks(draw(np.random.default_rng(seed), "")) for seed in range(30)] + [pagetext.blocks("")]
    together = labeller.logits(pagetext.numbered(read))
    alone = np.concatenate([labeller.logits(pagetext.numbered([r])) for r in read])
    assert np.abs(together - alone).max() < 1e-2
    x, y = pagetext.labelled([draw(np.random.default_rng(seed), pagetext.MARK) for seed in (3, 4, 5)])
    model = pagetext.Labeller({k: v.astype(np.float64) for k, v in pagetext.fresh_weights(np.random.default_rng(1)).items()})
    _, grads = pagetext.gradients(model, x, y)
    for key, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        step = []
        for sign in (1, -1):
            model.weights[key][at] += sign * 1e-2
            step.append(pagetext.gradients(model, x, y)[0])
            model.weights[key][at] -= sign * 1e-2
        assert abs((step[0] - step[1]) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-4, key


def test_page_edge_rows(spark, labeller):
    long = "<article>" + "<p>One more line of prose, it is said.</p>" * 30_000 + "</article>"
    rows = [(1, "u", None, "x"), (1, None, "", "x"), (None, "u", "<p>", "x"), (2, "u", long, "x"), (2, "u", long, "x"), (3, "u", "<nav><a href=/>Home</a></nav>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = pagetext.extract(df, labeller).collect()
    assert [r.n_chars for r in got][:3] == [0, 0, 0] and got[0].text == "" and got[3] == got[4]
    assert got[3].text == " ".join(["One more line of prose, it is said."] * 30_000) and got[5].text == ""
    assert pagetext.extract(df.limit(0), labeller).count() == 0
    assert pagetext.label_blocks(df, labeller).columns == [*df.columns, "blocks"]


def plain_repair(rows):
    """Every conversation's digest by a loop over its rows and a table of four states."""
    talks, out = {}, {}
    for c, t, r, x in rows:
        own = talks.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        own += [(t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    for c, own in talks.items():
        own.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), z[2].encode()))
        turns = {t for t, _, _ in own if t is not None}
        seen, faults = set(), []
        for _, r, x in own:
            shown = x.strip(" \t\n\v\f\r")
            faults.append("blank" if not shown else "duplicate" if (r, x) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((r, x))
        unlike = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, lines = cheapest([(r, x, f) for (_, r, x), f in zip(own, faults, strict=True)])
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, unlike, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def cheapest(rows):
    """Uniform-cost search over (rows done, last role), cheapest and ASCII-least first."""
    import heapq

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, lines = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, lines
        if (at, last) in done:
            continue
        done.add((at, last))
        follows = "a" if last == "u" else "u"
        role = {"u": "user", "a": "assistant"}[follows]
        heapq.heappush(heap, (cost + 3, audit + "I", at, follows, (*lines, role + ":")))
        if at < len(rows):
            r, x, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, follows, (*lines, f"{role}:{x}")))
                if r[:1] == follows or (r[:1] == "s" and last == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, r[:1], (*lines, f"{r}:{x}")))


def test_turn_repair(spark):
    rng = random.Random(5)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "a"], ["Hi.", "Hi.", "yes", "No!", "  ", "", None, "a. b", "end?  \n", "é.", "x.\n "]
    rows = [(c, rng.choice([t, t, t, t * 3, t - 2, None]), rng.choice(roles), rng.choice(texts)) for c in range(500) for t in range(rng.randrange(9))]
    rows += [(-7, t * 2 if t % 50 else None, rng.choice(["user", "assistant"]), rng.choice(["a.", "b.", f"c{t}.", f"d{t}"])) for t in range(400)]
    rows += [(-8, 5, "user", "a.")] * 2000 + [(-9, t, "user", "y" * 100_000 + ".") for t in range(3)]
    rows += [(None, 1, "user", "q."), (None, None, "assistant", "w"), (None, 70, "assistant", "w")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(5)
    assert {r[0]: tuple(r)[1:] for r in turnrepair.repair_digests(df).collect()} == plain_repair(rows)
    assert turnrepair.repair_digests(df.limit(0)).count() == 0


def test_turn_repair_without_any_row(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    got = turnrepair.repair_digests(spark.createDataFrame([(1, gone, "user", "x.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def plain_alignment(texts):
    """Links from the owner of every byte; groups from the ends that both share."""
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(tokenizer_path(crossalign.MODEL_A)), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(crossalign.MODEL_B))
    one.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    made, counts = [], Counter()
    for text in texts:
        raw = f" {text or ''}".encode()
        a, b = one.encode(f" {text or ''}", add_special_tokens=False).ids, two.encode(text or "")
        bytes_a = [bytes(code[c] for c in one.id_to_token(k)) for k in a]
        bytes_b = [bytes([int(two.id_to_piece(k)[3:5], 16)]) if two.is_byte(k) else two.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            made.append(None)
            continue
        owner_a, owner_b = ([k for k, x in enumerate(own) for _ in x] for own in (bytes_a, bytes_b))
        ends_a, ends_b = (list(itertools.accumulate(map(len, own))) for own in (bytes_a, bytes_b))
        links = [(a[i], b[j]) for i, j in sorted(set(zip(owner_a, owner_b, strict=True)))]
        counts.update(links)
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_i, to_j = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, a[i:to_i])) + "|" + ",".join(map(str, b[j:to_j])))
            i, j = to_i, to_j
        made.append((len(a), len(b), groups, links))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    none = (0, 0, 0, 0, 0, 0, "")
    return [none if m is None else (m[0], m[1], len(m[2]), len(m[3]), sum(counts[x] == top[x[1]] for x in m[3]), sum(counts[x] for x in m[3]), hashlib.sha256(";".join(m[2]).encode()).hexdigest()) for m in made]


@pytest.mark.parametrize(("share", "step"), [(crossalign.SHARE, crossalign.STEP), (500, 300)])
def test_token_alignment(spark, small, share, step):
    rng = random.Random(4)
    signs = [*"ab ▁\n\t é日\x00.1'<|s>", "<|endoftext|>", "<s>", "  ", "the ", " don't", "　", "́"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1000 + k, "".join(rng.choices(signs, k=rng.randrange(30)))) for k in range(600)]
    rows += [(None, None), (5, ""), (5, " "), (5, "a b"), (5, "a b"), (7, "x" * 50_000), (8, "a b " * 20_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, row string, pairs long").repartition(3)
    got = Counter(tuple(r) for r in crossalign.alignment(df, share=share, step=step).collect())
    want = Counter((r[0], *w) for r, w in zip(rows, plain_alignment([r[1] for r in rows]), strict=True))
    assert got == want
    assert crossalign.alignment(df.limit(0)).count() == 0


def test_pair_counts_add_up(spark, small):
    table = crossalign.tokenized(spark.read.parquet(f"{small}/documents.parquet"))
    links = table.agg(F.sum("n_links")).head()[0]
    pairs = crossalign.pair_counts(table)
    assert pairs.agg(F.sum("n")).head()[0] == links and pairs.groupBy("a", "b").count().where("count > 1").count() == 0
