"""Each opN_ query on small tables with awkward rows: against its SQL where it has some, else against a plain version of its contract."""

import glob
import hashlib
import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from tests.llm.test_operators import prose, rows
from tracemend import llm
from tracemend.llm import quality, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Copies, near copies, shared passages, benchmark text, nulls, empties, a long text; columns in excess and with clashing names."""
    path, draw = tmp_path_factory.mktemp("tables"), random.Random(31)
    texts = [prose(draw, draw.randrange(5, 120)) for _ in range(70)]
    passage, leak = prose(draw, 60), prose(draw, 30)
    texts += [texts[0], texts[0], texts[1] + " end", f"{prose(draw, 20)} {passage} {prose(draw, 9)}", f"{prose(draw, 30)} {passage}", f"{prose(draw, 8)} {leak} x"]
    texts += [None, "", " \n ", "a", "ab" * 900, "É <s>x</s> <|endoftext|> 你好 ", prose(draw, 5000), "".join("!? " for _ in range(80))]
    docs = [(i * 25, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    talk = [(c, k, r, t) for c in (1, 2) for k, (r, t) in enumerate([("user", "hi <|im_end|>"), ("assistant", "é\\ok"), ("user", None), ("assistant", "")])]
    tables = {
        "documents": spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS kept", "2 AS removed", "3 AS score", "4 AS bits", "5 AS `odd name`"),
        "labels": spark.createDataFrame([(i, int(bool(t) and "!?" not in t), int(i % 3 == 0)) for i, t, *_ in docs], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, leak), (2, texts[5]), (3, None), (4, "a")], "item_id long, text string"),
        "conversations": spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"),
        "pages": spark.createDataFrame([(1, "http://a.example.org/", "<nav>n</nav><article><h1>T &amp; t</h1><p><b>x<br><p>y</article>"), (2, None, None), (3, "u", "")], "page_id long, url string, html string"),
    }
    for name, t in tables.items():
        t.coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return str(path), docs


@pytest.fixture(scope="module")
def got(spark, folder):
    made = {}
    return lambda name: made.setdefault(name, rows(llm.queries()[name](spark, folder[0])))


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_matches_sql(got, folder, name):
    con = duckdb.connect()
    for p in glob.glob(f"{folder[0]}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}/*.parquet'")
    ran = con.execute(llm.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    want = sorted(tuple(map(str, (dict(zip(names, r, strict=True))[c] for c in sorted(names)))) for r in ran.fetchall())
    assert sorted(got(name)[0]) == sorted(names)
    assert sorted(tuple(str(r[c]) for c in sorted(names)) for r in got(name)) == want


@pytest.mark.parametrize(("name", "modulus", "left", "at"), [("op2_quality", 4, 2, 0.7), ("op4_toxicity", 5, 0, 0.5)])
def test_scores(got, folder, name, modulus, left, at):
    out = got(name)
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["doc_id"])] == [d[0] for d in folder[1]]
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == left)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= at)


def test_token_counts(got, folder):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: (len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t, *_ in folder[1]}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got("op5_token_counts")} == want and any(x[2] for x in want.values())


def slow_gear(raw: bytes, table) -> list[int]:
    """The gear hash after each byte, one byte at a time."""
    h, out = 0, []
    for b in raw:
        h = ((h << 1) + int(table[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def test_chunks(got, folder):
    """Chunks cut one byte at a time; of repeated ones, runs of 100 bytes and more go."""
    table = np.random.default_rng(23).integers(0, 1 << 32, 256, dtype=np.uint32)
    seen, want, least, most = set(), {}, 32, 128
    for i, t, *_ in folder[1]:
        raw, spans, at = (t or "").encode(), [], 0
        gear = slow_gear(raw, table)
        while len(raw) >= least and at < len(raw):
            end = next((e for e in range(at + least, min(at + most, len(raw)) + 1) if gear[e - 1] >> 28 == 0 and len(raw) - e >= least), None)
            if end is None:
                end = at + most if len(raw) - at >= most + least else len(raw)
            chunk = raw[at:end]
            if chunk in seen:
                if spans and spans[-1][1] == at:
                    spans[-1][1] = end
                else:
                    spans.append([at, end])
            seen.add(chunk)
            at = end
        spans = [s for s in spans if s[1] - s[0] >= 100]
        kept = b"".join(raw[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(raw)], strict=True))
        want[i] = (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got("op6_chunk_dedup")} == want
    assert sum(bool(x[1]) for x in want.values()) >= 3


def test_packing(got, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in folder[1]}
    of, packed = defaultdict(list), defaultdict(list)
    for r in got("op7_packing"):
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        of[r["doc_id"]].append((r["start"], r["length"]))
        packed[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, whole in [(of[i], len(x)) for i, x in ids.items()] + [(p, None) for p in packed.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == whole or (whole is None and at <= 4096)


def slow_fingerprint(text: str) -> int:
    """The vote of each term, bit by bit."""
    import math

    import xxhash

    mask, up = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def stir(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & mask
        return h ^ (h >> 31)

    raw = text.encode().lower()
    h = [xxhash.xxh3_64_intdigest(w) for w in raw.split()]
    terms = [stir(x) for x in h] + [stir((a * up + b) & mask) for a, b in zip(h, h[1:], strict=False)]
    runs = [stir(raw[k] + (raw[k + 1] << 8) + (raw[k + 2] << 16) + (raw[k + 3] << 24) + (1 << 40)) for k in range(len(raw) - 3)] if h else []
    votes, count = [0.0] * 64, {t: (terms.count(t), 1.0) for t in set(terms)}
    if math.exp(-len(h) / 8) > 1e-12:
        count |= {t: (runs.count(t), math.exp(-len(h) / 8)) for t in set(runs)}
    for t, (n, part) in count.items():
        for b in range(64):
            votes[b] += part * (1 + math.log2(n)) * (1 if t.to_bytes(8, "little")[b // 8] >> (7 - b % 8) & 1 else -1)
    return sum(1 << (63 - b) for b in range(64) if votes[b] > 1e-4)


def test_simhash(got, folder):
    order = sorted(folder[1], reverse=True, key=lambda d: d[0])
    near = lambda a, b: 1 - (a ^ b).bit_count() / 64
    found = {r["doc_id"]: r for r in got("op8_simhash")}
    prints = {d: int(r["fingerprint"], 16) for d, r in found.items()}
    for k, (i, t, *_) in enumerate(order):
        t, r, other = t or "", found[i], order[(k + 1) % len(order)]
        half = len(t) // 2
        changed = t[: len(t) - half] + (other[1] or "")[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        if len(t) < 5000:
            assert (prints[i] ^ slow_fingerprint(t)).bit_count() <= 1  # votes of sums near 0 may round apart
            assert (int(r["edited_fingerprint"], 16) ^ slow_fingerprint(changed)).bit_count() <= 1
        assert r["near_edited"] == near(prints[i], int(r["edited_fingerprint"], 16)) and r["near_next"] == near(prints[i], prints[other[0]])
        assert r["n_near"] == (sum((prints[i] ^ p).bit_count() <= 3 for p in prints.values()) - 1 if i % 50 == 0 else None)
    assert max(r["n_near"] or 0 for r in found.values()) >= 2


def test_quality_weights_are_the_optimum():
    """Against gradient descent on the same pairs; gradients against differences; scores against a direct sum."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, len(quality.features(""))))
    label = (x[:, 0] + 0.5 * x[:, 3] + draw.normal(size=300) > 0).astype(int)
    m = quality.fit(x, label, pairs=2000)
    z, pick = (x - m.centre) / m.scale, np.random.default_rng(1)
    d = z[pick.choice(np.flatnonzero(label == 1), 2000)] - z[pick.choice(np.flatnonzero(label == 0), 2000)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 1e-3 / 2 * w @ w
    w = np.zeros(len(m.weights))
    for _ in range(4000):
        w -= 0.5 * (-(d * (1 / (1 + np.exp(d @ w)))[:, None]).mean(axis=0) + 1e-3 * w)
    assert loss(m.weights) <= loss(w) + 1e-6 and np.abs(m.weights - w).max() < 0.05 * np.abs(w).max()
    steps = [(loss(m.weights + e) - loss(m.weights - e)) / 2e-5 for e in np.eye(len(w)) * 1e-5]
    assert np.abs(steps).max() < 1e-5
    by_hand = sum(m.weights[k] * (x[5, k] - m.centre[k]) / m.scale[k] for k in range(len(w)))
    assert abs(m.merit(x[5:6])[0] - by_hand) < 1e-9
    assert abs(m.score(x[5:6])[0] - 1 / (1 + np.exp(-((by_hand - m.cut) / m.spread + np.log(0.7 / 0.3))))) < 1e-9


def test_toxicity_weights_are_the_optimum():
    """Against gradient descent from differences of the loss, swap penalty included; scores against a direct sum."""
    draw, k = np.random.default_rng(5), 6
    on = [sorted(draw.choice(k, 3, replace=False).tolist()) for _ in range(80)]
    label = np.array([int(0 in r or draw.random() < 0.2) for r in on])
    x = np.array([[float(f in r) for f in range(k)] for r in on])
    pairs = [([1, 2], [3, 2]), ([1], [4])]
    w, bias = toxicity.fit(on, pairs, label, k, steps=3000)
    cost = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))

    def loss(v):
        z = x @ v[:k] + v[k]
        own = (cost * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - label * z)).mean()
        return own + 0.5 / 2 * (v[:k] ** 2).sum() / len(on) + 3.0 * np.mean([(v[a].sum() - v[b].sum()) ** 2 for a, b in pairs])

    slope = lambda v: np.array([(loss(v + e) - loss(v - e)) / 2e-6 for e in np.eye(k + 1) * 1e-6])
    at = np.zeros(k + 1)
    for _ in range(8000):
        at -= 0.05 * slope(at)
    found = np.append(w, bias)
    assert loss(found) <= loss(at) + 1e-4 and np.abs(slope(found)).max() < 1e-2
    m = toxicity.ToxicityModel({"scum": 0, "scum~": 1}, np.array([1.5, -0.25]), -0.5)
    assert abs(m.score({"scum", "other"}, {}) - 1 / (1 + np.exp(-(1.5 - 0.25 - 0.5)))) < 1e-12


def test_recall_of_links(spark):
    """Texts with a likeness just above the threshold, many seeds: no link is lost."""
    from tests.llm.test_operators import brute_components
    from tracemend.llm import minhash

    draw, items = random.Random(77), []
    for g in range(150):
        base = prose(draw, 150).split()
        items.append((3 * g, " ".join(base), "en", 0))
        for k in (1, 2):
            t = list(base)
            for _ in range(draw.randrange(2, 5)):
                t[draw.randrange(len(t))] = f"edit{draw.randrange(10**6)}"
            items.append((3 * g + k, " ".join(t), "en", 0))
    want = {i: c for i, (_, c) in brute_components(items, 3, 85).items()}
    df = spark.createDataFrame(items, "doc_id long, text string, lang string, extra int").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in rows(minhash.near_duplicates(df, 3, 85, 28, 6))}
    assert found == want and len(set(want.values())) < 400


def test_repeated_ids_and_clashing_names(spark):
    """An id with several texts: none is lost, taken for another, or cut by another's spans; ids near the end of their range."""
    from tracemend.llm import chunk_dedup, decontaminate, minhash, suffix_dedup

    draw, big = random.Random(2), 9_000_000_000_000_000_000
    a, b = prose(draw, 60), prose(draw, 60)
    docs = spark.createDataFrame([(1, a, 1, 2, 3), (2, a, 1, 2, 3), (2, b, 1, 2, 3), (2, b, 1, 2, 3), (None, a, 1, 2, 3)], "doc_id long, text string, kept int, spans int, `odd name` int")
    for spans in (suffix_dedup.repeated_spans(docs), chunk_dedup.repeated_chunks(docs)):
        got = sorted((r["doc_id"] or 0, bytes(r["kept"]).decode(), r["spans"], r["odd name"]) for r in rows(suffix_dedup.cut_spans(docs, spans)))
        assert got == sorted([(1, a, 2, 3), (2, "", 2, 3), (2, b, 2, 3), (2, b, 2, 3), (0, a, 2, 3)])
    near = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"], bytes(r["text_md5"])) for r in rows(minhash.near_duplicates(docs)))
    md5 = lambda t: hashlib.md5(t.encode()).digest()
    assert near == sorted([(1, 1, True, md5(a)), (2, 1, False, md5(a)), (2, 2, True, md5(b)), (2, 2, True, md5(b)), (0, 0, True, md5(a))])
    family = [(big + k, " ".join([*a.split()[:-1], f"end{k}"])) for k in range(6)]
    assert {r["component_id"] for r in rows(minhash.near_duplicates(spark.createDataFrame(family, "doc_id long, text string")))} == {big}
    odd = quality.quality_scores(docs.withColumnRenamed("kept", "score"), quality.fit(np.zeros((0, len(quality.features("")))), np.zeros(0)), "score", "odd name")
    assert {r["score"] for r in rows(odd)} == {quality.KEEP_AT} and "odd name" in odd.columns
    found = {(r["doc_id"], bytes(r["text_md5"])): r["items"] for r in rows(decontaminate.find_contamination(docs, spark.createDataFrame([(9, b)], "item_id long, text string")))}
    assert found[(2, md5(b))] == ["9"] and found[(2, md5(a))] == []


def test_the_pipeline_keeps_one_row_of_a_repeated_id(spark):
    import corpus_pipeline

    draw = random.Random(4)
    a, b = prose(draw, 60), prose(draw, 60)
    data = [(1, a), (2, a), (2, b), (2, b), (3, None), (3, None), (None, a), (4, b + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], DOCS)
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in rows(corpus_pipeline.near_duplicate_stage(spark, docs, "")))
    assert got == sorted([(0, a), (1, a), (2, b), (3, ""), (3, "")])


def test_empty_tables_and_clashing_columns_in_the_stages(spark, tmp_path):
    import corpus_pipeline

    text = "word " * 30_000 + prose(random.Random(1), 40)
    for k, data in enumerate(([], [(1, text, "en", "s", len(text), 7), (2, "short one", "en", None, None, 7)])):
        path = f"{tmp_path}/{k}"
        spark.createDataFrame(data, DOCS + ", kept int").write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
            assert out.columns == corpus_pipeline.COLUMNS and out.count() == len(data)
        assert corpus_pipeline.run(spark, path).where("start = 0").count() == len(data)


CHATML = """{% for message in messages %}{{ '<|im_start|>' + message['role'] + '\n' + message['content'] + '<|im_end|>' + '\n' }}{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}"""
INSTRUCT = """{% if messages[0]['role'] == 'system' %}{% set rest = messages[1:] %}{% set system = messages[0]['content'] %}{% else %}{% set rest = messages %}{% set system = false %}{% endif %}{% for message in rest %}{% if (message['role'] == 'user') != (loop.index0 % 2 == 0) %}{{ raise_exception('roles must alternate') }}{% endif %}{% if loop.index0 == 0 and system is not false %}{% set content = '<<SYS>>\n' + system + '\n<</SYS>>\n\n' + message['content'] %}{% else %}{% set content = message['content'] %}{% endif %}{% if message['role'] == 'user' %}{{ bos + '[INST] ' + content.strip() + ' [/INST]' }}{% elif message['role'] == 'assistant' %}{{ ' ' + content.strip() + ' ' + eos }}{% endif %}{% endfor %}"""
LAST = """{%- set ns = namespace(n=0, last=-1) -%}{%- for m in messages -%}{%- if m.role == 'user' -%}{%- set ns.n = ns.n + 1 -%}{%- set ns.last = loop.index0 -%}{%- endif -%}{%- endfor -%}{{ ns.n }}:{{ messages[ns.last].content | upper }}:{{ messages[-1].role }}{% if tools is defined %} tools{% endif %}"""


def test_common_template_shapes():
    from tracemend.llm import chat

    run = lambda source, **env: "".join(t for t, _ in chat.compile_template(source)(env))
    say = lambda *turns: [{"role": r, "content": c} for r, c in turns]
    talk = say(("user", " hi "), ("assistant", "yes "))
    assert run(CHATML, messages=talk, add_generation_prompt=True) == "<|im_start|>user\n hi <|im_end|>\n<|im_start|>assistant\nyes <|im_end|>\n<|im_start|>assistant\n"
    assert run(INSTRUCT, messages=talk, bos="<s>", eos="</s>") == "<s>[INST] hi [/INST] yes </s>"
    assert run(INSTRUCT, messages=say(("system", "be short"), ("user", "q")), bos="<s>", eos="</s>") == "<s>[INST] <<SYS>>\nbe short\n<</SYS>>\n\nq [/INST]"
    with pytest.raises(chat.TemplateError, match="alternate"):
        run(INSTRUCT, messages=say(("assistant", "x")), bos="", eos="")
    assert run(LAST, messages=[*talk, *say(("user", "more"))]) == "2:MORE:user" and run(LAST, messages=talk, tools=None) == "1: HI :assistant tools"
    assert run("{{ 7 // 2 }}{{ -3 + 5 }}{{ 2 * 3 - 1 }}{{ x[1:2][0] if x is iterable else 0 }}{{ 'a' in ['a', y] }}", x=[4, 5], y=1) == "3255True"
    for bad in ("{{ x.format() }}", "{{ open('f') }}", "{{ namespace(1) }}", "{{ x is callable }}", "{{ [1, }}", "{{ x[ }}", "{{ 1 - }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    for bad, x in (("{{ x.__class__ }}", [1]), ("{{ x['__len__'] }}", [1]), ("{{ x * 9 }}", "a"), ("{{ 1 % 0 }}", 0), ("{{ x.strip() }}", [1]), ("{% set x.y = 1 %}", {}), ("{{ x[5] }}", [1])):
        with pytest.raises(chat.TemplateError):
            run(bad, x=x)
