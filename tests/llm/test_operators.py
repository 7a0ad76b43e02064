"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracemend.llm import chat, chunk_dedup, decontaminate, minhash, packing, quality, simhash, suffix_dedup, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, extra int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon été größe señor".split()


def prose(draw, n):
    return " ".join(draw.choice(WORDS) + str(draw.randrange(400)) for _ in range(n))


def corpus():
    """Ordinary texts, copies, near copies, shared passages, nulls, empties, a long text, a repeated row."""
    draw = random.Random(5)
    texts = [prose(draw, draw.randrange(1, 120)) for _ in range(30)]
    passage = prose(draw, 60)
    texts += [texts[3], texts[3], texts[4] + " end", passage, prose(draw, 20) + " " + passage + " " + prose(draw, 20), "x" + passage]
    base = prose(draw, 200).split()
    for k in (0, 1, 2, 40):
        t = list(base)
        for i in range(k):
            t[i * 4 + 2] = f"new{k}{i}"
        texts.append(" ".join(t))
    texts += [None, "", "   \n", "a", "é", "ab" * 300, "==" * 400, prose(draw, 4000), "\x00\x00 nul", "日本語のテキスト" * 20]
    rows = [(i * 3, t, "en", i) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, texts[6], None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_token_counts(docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t, *_ in corpus() if i is not None)
    got = rows(token_counts.token_counts(docs, path))
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got if r["doc_id"] is not None) == want
    assert len(got) == len(corpus()) and all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    assert rows(token_counts.token_counts(none, path)) == []


def test_token_cuts_are_exact():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    whole, cuts = token_counts.prove(path)
    assert cuts and len(whole) > 20_000 and all(len(token_counts.merger(sp).__call__(w) and [1]) == 1 for w in list(whole)[:50])
    counts, split = token_counts.Counts(path, whole, 50), __import__("re").compile(r" *[^ \n]+|\n| +").findall
    draw = random.Random(1)
    for _ in range(3000):
        t = "".join(draw.choice(" \n\tab▁<s>éß你.\r0T") for _ in range(draw.randrange(1, 14)))
        assert sum(counts[p] for p in split(" " + t.replace("▁", " "))) == len(sp.encode(t)), repr(t)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = rows(packing.pack(docs, packing.library_encoder(path), capacity=512))
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in corpus()}
    pieces, sequences = defaultdict(set), defaultdict(list)
    for r in got:
        ids = want[r["doc_id"]]
        cut = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert zlib.crc32(cut) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
        pieces[r["doc_id"]].add((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, ids in want.items():
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at
            at += n
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 512
    assert sum(n for s in sequences.values() for _, n in s) > 0.9 * 512 * len(sequences)
    assert rows(packing.pack(none, packing.library_encoder(path))) == []


def test_cuts_add_up():
    for n in (1, 2, 47, 48, 49, 100, 2047, 2048, 2049, 4095, 4096, 4097, 30_000):
        pieces = packing.cut(n, 4096)
        assert sum(length for length, _ in pieces) == n and all(length * k <= 4096 for length, k in pieces)


def test_word_ids_match_the_library():
    w = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), most=500)
    draw = random.Random(3)
    for t in [prose(draw, 50), "<|endoftext|>a", "don't İstanbul ΣΑΣ", "\x1ca b", "１２ 你好　x", "ﬁ ǅ ŉ ſ", ""]:
        assert w.of(t) == w.whole(t)
    for alphabet in ("aZé'ÀœŒſİß!<|>.,*0 ́Σ你\n-_^`~\x7f\xa0×÷stdm", "aZé'ÀœßS!<>.,*0 \n-_^`~stdm|"):
        for _ in range(3000):
            t = "".join(draw.choice(alphabet) for _ in range(draw.randrange(1, 12)))
            assert w.of(t) == w.whole(t), repr(t)


def brute_components(items, width, percent):
    sets = {}
    for i, t, *_ in items:
        w = (t or "").encode().lower().split()
        if i is not None:
            sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent", "bands", "size"), [(3, 85, 28, 6), (5, 80, 33, 5)])
def test_near_duplicates(docs, none, width, percent, bands, size):
    want = brute_components(corpus(), width, percent)
    got = rows(minhash.near_duplicates(docs, width, percent, bands, size))
    assert len(got) == len(corpus())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])
    assert len({c for _, c in want.values()}) < len(want) - 4
    assert rows(minhash.near_duplicates(none)) == []


def test_near_duplicates_in_a_hot_group(spark, monkeypatch):
    """Many texts around one, so that buckets hold several components and are compared in blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    draw = random.Random(8)
    base = prose(draw, 120).split()
    items = []
    for i in range(60):
        t = list(base)
        for _ in range(draw.randrange(0, 9)):
            t[draw.randrange(len(t))] = f"edit{draw.randrange(10**6)}"
        items.append((i, " ".join(t), "en", 0))
    want = brute_components(items, 3, 85)
    got = rows(minhash.near_duplicates(spark.createDataFrame(items, DOCS).repartition(4), 3, 85, 28, 6))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def brute_spans(items, length):
    first, raw = {}, {i: (t or "").encode() for i, t, *_ in items if i is not None}
    covered = {i: bytearray(len(t)) for i, t in raw.items()}
    for i in sorted(raw):
        t = raw[i]
        for s in range(len(t) - length + 1):
            if first.setdefault(t[s : s + length], (i, s)) != (i, s):
                covered[i][s : s + length] = b"\1" * length
    return raw, covered


@pytest.mark.parametrize("tiny", [False, True])
def test_suffix_dedup(docs, none, monkeypatch, tiny):
    if tiny:  # many slices and range buckets, so that strings meet across their boundaries
        monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 2000)
        monkeypatch.setattr(suffix_dedup, "SUFFIXES", 5)
        monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(suffix_dedup, "BROADCAST_SPANS", 0)
    raw, covered = brute_spans(corpus(), 100)
    got = rows(suffix_dedup.cut_spans(docs, suffix_dedup.repeated_spans(docs)))
    assert len(got) == len(corpus())
    for r in got:
        if r["doc_id"] is not None:
            kept = bytes(b for b, c in zip(raw[r["doc_id"]], covered[r["doc_id"]], strict=True) if not c)
            assert bytes(r["kept"]) == kept and len(r["removed"]) == len([1 for p, c in zip(b"\0" + covered[r["doc_id"]], covered[r["doc_id"]], strict=False) if c and not p])
    assert sum(map(sum, covered.values())) > 1000
    assert rows(suffix_dedup.cut_spans(none, suffix_dedup.repeated_spans(none))) == []


def test_suffix_dedup_around_common_lines(spark, monkeypatch):
    """Anchors that share their gram in many spans, cut over range buckets."""
    monkeypatch.setattr(suffix_dedup, "SUFFIXES", 9)
    draw = random.Random(2)
    line = "this licence line of some sixty bytes stands in every document here"
    items = [(i, f"{draw.choice(('left one ', 'other left '))}{prose(draw, 3)} {draw.choice(('tail A ', 'tail B ')) * 2}{line} {draw.choice(('one right side that is long enough ', 'another right side ')) * 2}{prose(draw, 3)}", "en", 0) for i in range(50)]
    raw, covered = brute_spans(items, 100)
    df = spark.createDataFrame(items, DOCS).repartition(6)
    got = {r["doc_id"]: bytes(r["kept"]) for r in rows(suffix_dedup.cut_spans(df, suffix_dedup.repeated_spans(df)))}
    assert got == {i: bytes(b for b, c in zip(raw[i], covered[i], strict=True) if not c) for i in raw}


def test_whole_characters(spark):
    t = "é" * 120
    df = spark.createDataFrame([(1, t, "en", 0), (2, "x" + t, "en", 0)], DOCS)
    got = rows(suffix_dedup.cut_spans(df, suffix_dedup.repeated_spans(df, 101), whole_characters=True))
    assert all(bytes(r["kept"]).decode() is not None for r in got)


def test_chunks(docs, none):
    got = rows(suffix_dedup.cut_spans(docs, chunk_dedup.repeated_chunks(docs, 32, 256, 5, 0)))
    seen, want = set(), {}
    texts = {i: (t or "").encode() for i, t, *_ in corpus() if i is not None}
    for i in sorted(texts):
        x = chunk_dedup.chunks([texts[i]], [i], 32, 256, 5)
        kept, at = b"", 0
        for c in np.sort(x, order="a"):
            end = int(c["a"]) + 32 + int(c["more"])
            assert c["a"] == at
            if (key := texts[i][at:end]) not in seen:
                kept += key
            seen.add(key)
            at = end
        assert at == len(texts[i]) or len(texts[i]) < 32
        want[i] = kept if len(x) else texts[i]
    assert {r["doc_id"]: bytes(r["kept"]) for r in got if r["doc_id"] is not None} == want
    assert sum(map(len, want.values())) < sum(map(len, texts.values()))
    assert rows(chunk_dedup.repeated_chunks(none)) == []


def test_chunks_before_a_short_tail(spark):
    """A text whose last cut falls just after a forced end, and an exact copy: lengths are true and no chunk is under the least."""
    assert chunk_dedup.boundaries([257], 260, 32, 256) == [260]
    draw = random.Random(6)
    for _ in range(2000):
        size = draw.randrange(32, 900)
        sizes = np.diff([0, *chunk_dedup.boundaries(sorted(draw.sample(range(1, size + 1), draw.randrange(6))), size, 32, 256)])
        assert sizes.sum() == size and sizes.min() >= 32 and sizes.max() < 256 + 32
    cuts = lambda t: np.flatnonzero(chunk_dedup.gear_hashes(np.frombuffer(t.encode(), np.uint8)) >> np.uint32(27) == 0) + 1
    letters = [chr(c) for c in range(33, 127)]
    flat = next(c * 256 for c in letters if not len(cuts(c * 256)))
    t = next(x for a in letters for b in letters if len(k := cuts(x := flat + a + b + a + b)) and k[0] > 256)
    df = spark.createDataFrame([(1, t, "en", 0), (2, t, "en", 0)], DOCS)
    got = {r["doc_id"]: r for r in rows(suffix_dedup.cut_spans(df, chunk_dedup.repeated_chunks(df, 32, 256, 5, 0)))}
    assert [sum(s["end"] - s["start"] for s in got[i]["removed"]) for i in (1, 2)] == [0, len(t)]
    assert [bytes(got[i]["kept"]).decode() for i in (1, 2)] == [t, ""]


def test_chunks_resist_shifts():
    draw = random.Random(4)
    t = prose(draw, 400).encode()
    ends = lambda raw: {raw[int(c["a"]) : int(c["a"]) + 32 + int(c["more"])] for c in chunk_dedup.chunks([raw], [1], 32, 256, 5)}
    assert len(ends(t) & ends(b"inserted " + t)) > 0.9 * len(ends(t))


def test_simhash(docs, none, spark):
    got = rows(simhash.with_next(docs))
    order = sorted((x for x in corpus() if x[0] is not None), key=lambda x: (x[0], x[1] or ""), reverse=True)
    order += [x for x in corpus() if x[0] is None]
    make = simhash.Fingerprinter()
    want = []
    for k, (i, t, *_) in enumerate(order):
        t, other = t or "", order[(k + 1) % len(order)][1] or ""
        changed = simhash.edit(t, other)
        a, b, c = make(t), make(changed), make(other)
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), a.hex(), b.hex(), simhash.likeness(a, b), simhash.likeness(a, c)))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(r.values()) for r in got), key=key) == sorted(want, key=key)
    assert rows(simhash.with_next(none)) == []
    one = rows(simhash.with_next(spark.createDataFrame([(7, "just one text", "en", 0)], DOCS)))
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_within_radius(spark):
    draw = random.Random(6)
    prints = [draw.getrandbits(64) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in draw.sample(range(64), k)) for p in prints[:30] for k in (1, 2, 3, 4)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    got = {(r["query"], r["fingerprint"]): r["distance"] for r in rows(simhash.within_radius(df, df))}
    want = {(a, b): d for a, x in zip(signed, prints, strict=True) for b, y in zip(signed, prints, strict=True) if (d := (x ^ y).bit_count()) <= 3}
    assert got == want


def brute_hits(text, items, window):
    w = decontaminate.words(text)
    hit, found = set(), set()
    for item, t in items:
        b = decontaminate.words(t)
        for k in range(max(1, len(b) - window + 1) if b else 0):
            g = b[k : k + window]
            for s in range(len(w) - len(g) + 1):
                if w[s : s + len(g)] == g:
                    hit.update(range(s, s + len(g)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [4 << 20, 200])
def test_decontamination(docs, none, spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)  # the small one takes several rounds
    texts = [t for _, t, *_ in corpus()]
    items = [(1, texts[10]), (2, " ".join(texts[3].split()[2:14])), (3, "a"), (4, None), (5, ""), (6, texts[33].upper()), (7, "never seen words here at all in any of the documents above"), (None, texts[1]), (8, "ab" * 300)]
    bench = spark.createDataFrame([(*x, "m") for x in items], "item_id long, text string, lang string")
    got = rows(decontaminate.find_contamination(docs, bench))
    assert len(got) == len(corpus())
    known = {i: t for i, t, *_ in corpus()}
    for r in got:
        n, hit, found = brute_hits(known[r["doc_id"]], [x for x in items if x[0] is not None], 10)
        assert (r["n_words"], sum(b - a for a, b in r["runs"]), r["items"]) == (n, hit, found)
    assert sum(bool(r["items"]) for r in got) >= 6
    assert rows(decontaminate.find_contamination(none, bench)) == []
    assert all(not r["items"] for r in rows(decontaminate.find_contamination(docs, bench.limit(0))))


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, item), (2, item.replace("five", "oh five")), (3, "ten nine eight seven six five four three two one")], "doc_id long, text string")
    got = {r["doc_id"]: (r["items"], r["near_items"]) for r in rows(decontaminate.find_contamination(df, spark.createDataFrame([(9, item)], "item_id long, text string")))}
    assert got == {1: (["9"], []), 2: ([], ["9"]), 3: ([], [])}


def labelled(spark, n=400):
    draw = random.Random(9)
    out = []
    for i in range(n):
        t = prose(draw, draw.randrange(20, 80))
        good = i % 4 != 0
        toxic = i % 5 == 0
        words = t.split()
        if toxic:
            words[3] = draw.choice(["idiot", "moronic", "scum"])
        if i % 3 == 0 or (toxic and i % 2):
            words[7] = draw.choice(["women", "muslims", "refugees"])
        out.append((i, " ".join(words) if good else "!! ".join(words).upper(), int(good), int(toxic)))
    extra = [(n, None, 1, 0), (n + 1, "", 1, 0)]
    df = spark.createDataFrame(out + extra, "doc_id long, text string, good int, toxic int")
    return df.select("doc_id", "text", F.lit("en").alias("label")), df.select("doc_id", F.col("good").alias("label")), df.select("doc_id", F.col("toxic").alias("label"))


def test_quality(spark, none):
    docs, good, _ = labelled(spark)
    held = F.col("doc_id") % 7 == 0
    model = quality.train(docs, good.where(~held))
    got = {r["doc_id"]: r["score"] for r in rows(quality.quality_scores(docs, model))}
    truth = {r["doc_id"]: r["label"] for r in rows(good.where(held))}
    assert np.mean([(got[i] >= quality.KEEP_AT) == bool(y) for i, y in truth.items()]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[400] == got[401]
    assert rows(quality.quality_scores(none, model)) == []
    blank = quality.train(docs, good.limit(0))
    assert {round(r["score"], 6) for r in rows(quality.quality_scores(docs, blank))} == {quality.KEEP_AT}


def test_toxicity(spark, none):
    docs, _, toxic = labelled(spark)
    held = F.col("doc_id") % 7 == 0
    model = toxicity.train(docs, toxic.where(~held))
    got = {r["doc_id"]: r["score"] for r in rows(toxicity.toxicity_scores(docs, model))}
    truth = {r["doc_id"]: r["label"] for r in rows(toxic.where(held))}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in truth.items()]) > 0.97
    assert got[400] == got[401]
    assert rows(toxicity.toxicity_scores(none, model)) == []
    assert {r["score"] for r in rows(toxicity.toxicity_scores(docs, toxicity.train(docs, toxic.limit(0))))} == {0.5}


def test_swaps_change_scores_less_with_the_penalty(spark):
    """Where a group term goes with the label by chance, the penalty takes weight from it."""
    draw = random.Random(12)
    out = []
    for i in range(300):
        toxic = i % 3 == 0
        t = prose(draw, 12).split()
        t[2] = "women" if toxic == (i % 10 != 0) else "men"
        t[5] = "scum" if toxic and i % 2 else t[5]
        out.append((i, " ".join(t), int(toxic)))
    df = spark.createDataFrame(out, "doc_id long, text string, label int")
    gap = []
    for fairness in (0.0, 3.0):
        m = toxicity.train(df, df.select("doc_id", "label"), fairness=fairness)
        gap.append(abs(m.score({"some", "women"}, {}) - m.score({"some", "men"}, {})))
    assert gap[1] < 0.5 * gap[0]


def test_chat_round_trip(spark):
    draw = random.Random(3)
    said = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "", None, "a\nb", "<", "|>", "\\", "é你", "x" * 5000]
    data = [(c, k, draw.choice(["user", "assistant", "system", None, "odd\nrole<|"]), draw.choice(said), "extra") for c in (1, 2, None) for k in range(40)]
    data += [data[0], (3, 0, "assistant", "only", "e")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in rows(chat.read_back(chat.format_conversations(df, part_chars=3000)))}
    for c in (1, 2, 3, None):
        turns = sorted(((k, r or "", t or "") for i, k, r, t, _ in data if i == c))
        text = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert rows(chat.read_back(chat.format_conversations(df.limit(0)))) == []


@pytest.mark.parametrize("last", ["", None])
def test_chat_is_cut_between_turns_only(spark, last):
    """A turn's header passes the size of a part just before an empty text."""
    df = spark.createDataFrame([(1, 0, "user", "x" * 100), (1, 1, "assistant", last), (1, 2, "user", "end")], "conv_id long, turn long, role string, text string")
    head = len("<|im_start|>user\n" + "x" * 100 + "<|im_end|>\n<|im_start|>assistant\n")
    for most in (head - 1, head):
        parts = sorted((r["part"], r["formatted"]) for r in rows(chat.format_conversations(df, part_chars=most)))
        assert len(parts) > 1 and all(p == "" or p.endswith("<|im_end|>\n") for _, p in parts)
        got = rows(chat.read_back(chat.format_conversations(df, part_chars=most)))
        assert [(r["n_turns"], r["turns_sha256"]) for r in got] == [(3, hashlib.sha256(f"user\n{'x' * 100}\nassistant\n\nuser\nend\n".encode()).hexdigest())]


def test_templates():
    run = lambda source, **env: "".join(t for t, _ in chat.compile_template(source)(env))
    assert run("{% for x in xs %}{{ loop.index }}{{ x.a | upper }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=[{"a": "p"}, {"a": "q"}]) == "1P, 2Q"
    assert run("a {%- set y = 'b' ~ x %} {{ y if x == 'c' else 'd' }}{# no #}", x="c") == "a bc"
    assert run("{% if false %}x{% elif a in 'abc' and true %}y{% else %}z{% endif %}", a="b") == "y"
    folded = chat.fold_body(chat.Parser("a{{ 'b' ~ 'c' | upper }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}e").parse())
    assert folded == [chat.Text("abCde")]
    for bad in ("{{ x.__class__() }}", "{{ x | open }}", "{% import os %}", "{% for x in %}{% endfor %}", "{% if x %}", "{{ 'a }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    with pytest.raises(chat.TemplateError):
        run("{{ x.__class__ }}", x="text")
    assert [p for p in chat.compile_template("{% generation %}{{ x }}{% endgeneration %}!")({"x": "y"})] == [("y", True), ("!", False)]


def test_proofs_come_from_the_files():
    """A model or tokenizer that says otherwise in its file is read the long way."""
    import json

    from tracemend.llm.packing import reads_plainly
    from tracemend.llm.token_counts import separable, wire_fields

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        raw = f.read()
    assert separable(raw) and token_counts.prove(public_tokenizers.path("piece_bpe_32k.model"))[1]
    field = lambda n, v: bytes([n << 3 | 2, len(v)]) + v
    assert not separable(raw + field(1, field(1, b"piece") + b"\x18\x04"))  # a piece of the user's
    assert not separable(raw + field(3, b"\x18\x01\x20\x01")) and not separable(raw + field(3, field(2, b"map") + b"\x20\x00")) and not separable(raw + field(2, b"\x18\x01"))
    assert list(wire_fields(field(5, b"ab") + b"\x08\xac\x02")) == [(5, b"ab"), (1, 300)]
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        said = json.load(f)
    assert reads_plainly(said) and packing.WordIds(public_tokenizers.path("word_bpe_49k.json")).direct
    for key, value in (("normalizer", {"type": "Sequence", "normalizers": [{"type": "Lowercase"}]}), ("pre_tokenizer", None), ("post_processor", {"type": "ByteLevel"}), ("added_tokens", [{"content": "and"}])):
        assert not reads_plainly(said | {key: value})
