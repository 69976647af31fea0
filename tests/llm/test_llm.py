"""The operators for training text: small cases, edges, brute force and round trips."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from biblioflow.llm import leakage, lookalike, mixing, mojibake, truncation


def test_truncation(spark):
    rng = random.Random(3)
    words = "the model of hard carbon limits charge transfer in fuel cells above all".split()

    def text(n):
        out = ""
        while len(out) < n:
            out += " ".join(rng.choice(words) for _ in range(9)).capitalize() + ". "
        return out.strip()

    rows, cut = [], set()
    for i in range(400):
        whole = text(rng.randrange(80, 600))
        if i % 2 and len(whole) > 250:
            rows.append((i, "limited", whole[:250]))
            if not whole[:250].rstrip().endswith("."):
                cut.add(i)
        else:
            rows.append((i, "limited" if i % 2 else None, whole))
    extra = [("Whole. © 2024 The Authors", False), ("Whole. Keywords: a; b", False), ("It was cut in mi...", True), ("It was cut […]", True), ("Whole sentence. […]", False), ("<p>Whole.</p>", False), ("<p>Cut in mid", True), (None, False), ("", False), ("结果表明，二氧化硅", True), ("结论。", False), ("x" * 100_000, True)]
    for k, (t, is_cut) in enumerate(extra):
        rows.append((1000 + k, "other", t))
        if is_cut:
            cut.add(1000 + k)
    df = spark.createDataFrame(rows, "paper_id long, source string, abstract string").withColumn("base", F.lit(1)).withColumn("_len", F.lit("x"))
    assert {r.paper_id for r in truncation.truncated(df).collect()} == cut
    report = {r.source: r for r in truncation.truncation_report(df).collect()}
    assert report["limited"].limits == "250" and report[None].cut == 0
    assert truncation.truncated(df.limit(0)).count() == 0


def _lengths_and_endings(n=30_000, limit=420, seed=5):
    """A histogram of one source: log-normal lengths, a limit, sentences with decimals, and random breaks."""
    rng = np.random.default_rng(seed)
    lens = np.exp(rng.normal(6.1, 0.5, n)).astype(int) + 20
    kinds = rng.choice(["whole", "stub_number", "note"], n, p=[0.97, 0.01, 0.02]).astype(object)
    over = (lens > limit) & (rng.random(n) < 0.6)
    kinds[over], lens[over] = rng.choice(["open", "stub_number"], over.sum(), p=[0.97, 0.03]), limit
    broken = ~over & (rng.random(n) < 0.02)
    kinds[broken], lens[broken] = "open", (lens[broken] * rng.random(broken.sum())).astype(int) + 1
    cells = pd.DataFrame({"_len": lens, "_kind": kinds}).groupby(["_len", "_kind"]).size().rename("n").reset_index()
    trials = np.array([0.0 if k == "omitted" else 970.0 if k == "open" else 30.0 if k == "stub_number" else 0.1 for k in truncation.KINDS])
    whole = np.array([truncation.OPEN_COMPLETE / 2] * 2 + [0.01, 0.001, 0.001, 0.96, 0.02])
    return cells, trials / trials.sum(), whole


def test_length_decides_between_equal_endings(monkeypatch):
    cells, trials, whole = _lengths_and_endings()
    fitted = truncation.fit_source(cells, trials, whole)
    stub = fitted[fitted["_kind"] == "stub_number"].set_index("_len")
    assert stub.loc[420, "posterior"] > 0.5 and (stub.drop(420)["posterior"] < 0.5).all()
    assert abs(fitted["mu"].iloc[0] - 6.1) < 0.1
    cut = lambda f: set(map(tuple, f[f["posterior"] > 0.5][["_len", "_kind"]].to_numpy()))
    monkeypatch.setattr(truncation, "LIMIT_LEAST", 10**9)  # a model that sees no limits gives other verdicts on the same texts
    assert cut(truncation.fit_source(cells, trials, whole)) != cut(fitted)


def test_a_source_that_never_closes_its_texts_is_told_by_nothing_else_than_the_prior():
    rng = np.random.default_rng(2)
    lens = np.exp(rng.normal(6.1, 0.3, 5000)).astype(int)
    cells = pd.DataFrame({"_len": lens, "_kind": "note"}).groupby(["_len", "_kind"]).size().rename("n").reset_index()
    _, trials, whole = _lengths_and_endings(2000)
    assert (truncation.fit_source(cells, trials, whole)["posterior"] < 0.5).all()


def test_endings_behind_a_long_tail(spark):
    tail, note = "</p>" * 400 + " " * 700, "© 2024 " + "The Authors and their institutions, " * 30
    rows = [(1, "s", "It was cut in mi" + tail), (2, "s", "A whole sentence." + tail), (3, "s", "A whole sentence. " + note), (4, "s", " " * 900), (5, None, None)]
    df = spark.createDataFrame(rows, "paper_id long, source string, abstract string")
    assert {r.paper_id: r.ending for r in truncation.score_truncation(df).collect()} == {1: "open", 2: "whole", 3: "note"}
    assert {r.paper_id for r in truncation.truncated(df).collect()} == {1}


def test_censored_fit_recovers_the_parameters():
    rng = np.random.default_rng(1)
    y = np.exp(rng.normal(6.0, 0.5, 20_000))
    whole, cut = y[y < 500], y[y >= 500]
    mu, sigma = truncation.fit_censored_lognormal(whole, np.ones_like(whole), np.full_like(cut, 500), np.ones_like(cut))
    assert abs(mu - 6.0) < 0.03 and abs(sigma - 0.5) < 0.03


@pytest.mark.parametrize("charset", ["cp1252", "mac_roman", "cp437", "cp1251", "latin-1"])
@pytest.mark.parametrize("layers", [1, 2])
def test_charset_round_trip(charset, layers):
    for text in ("Étude de la porosité à 40 °C – Schrödinger", "no loss of MnO₂ after 3 mA cm⁻²", "结果表明，二氧化硅显著提高了电导率。", "Показано, что оксид церия"):
        broken = text
        try:
            for _ in range(layers):
                broken = broken.encode("utf-8").decode(charset)
        except UnicodeDecodeError:
            continue
        assert mojibake.repair(broken)[0] == text


@pytest.mark.parametrize("charset, text", [("koi8_r", "Привет, мир"), ("gbk", "结果表明显著提高"), ("shift_jis", "電導率を示した"), ("cp1254", "Étude à 40 °C")])
def test_charsets_are_a_parameter(spark, charset, text):
    broken, charsets = text.encode("utf-8").decode(charset), (*mojibake.LEGACY_CHARSETS, charset)
    assert mojibake.repair(broken, charsets)[0] == text and mojibake.repair(text, charsets)[1] == 0
    df = spark.createDataFrame([(1, broken, text), (2, None, "")], "paper_id long, title string, abstract string")
    assert [(r.paper_id, r.field_name, r.repaired) for r in mojibake.garbled_values(df, charsets=charsets).collect()] == [(1, "title", text)]


def test_sound_text_is_left_alone(spark):
    for text in ("ÉTUDE DE LA DENSITÉ «ÉTÉ»", "Øresund Ångström façade naïve", "«ГИДРИД» и оксид", "Ελλάδα αβγ", "p &lt; 0.05 &amp; more", "50 °C ± 3 µm", None, ""):
        assert mojibake.repair(text)[1:] == (0, False)
    df = spark.createDataFrame([(1, "CafÃ© au lait", None), (2, "Caf� au lait", "sound é"), (3, "sound", "stretch of cafÃ© and à la carte"), (4, None, "a&acirc;&euro;&ldquo;b")], "paper_id long, title string, abstract string").withColumn("text", F.lit("clash"))
    rows = {(r.paper_id, r.field_name): (r.repaired, r.recovered) for r in mojibake.garbled_values(df).collect()}
    assert rows == {(1, "title"): ("Café au lait", True), (2, "title"): ("Caf� au lait", False), (3, "abstract"): ("stretch of café and à la carte", True), (4, "abstract"): ("a–b", True)}
    fixed = {r.paper_id: (r.title, r.abstract) for r in mojibake.repair_columns(df).collect()}
    assert fixed[1] == ("Café au lait", None) and fixed[4] == (None, "a–b") and fixed[2][1] == "sound é"
    assert mojibake.garbled_values(df.limit(0)).count() == 0


def test_suffix_array_and_index():
    rng = np.random.default_rng(5)
    sequence = np.concatenate([rng.integers(1, 6, 3000), [0]]).astype(np.int32)
    order = leakage.suffix_array(sequence)
    assert order.tolist() == sorted(range(len(sequence)), key=lambda i: sequence[i:].tolist())
    index = leakage.FMIndex.restore(leakage.FMIndex.over(sequence, 6).packed(), 6)
    tokens = rng.integers(2, 6, (200, 4)).astype(np.int32)
    which, low, high = index.search(tokens)
    found = {w: sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which.tolist(), low.tolist(), high.tolist())}
    for k, phrase in enumerate(tokens):
        exact = [i for i in range(len(sequence) - 3) if (sequence[i : i + 4] == phrase).all()]
        assert found.get(k, []) == exact


def test_leakage(spark):
    passage = "Trolley 22 reached Goriposhaw Gate 75.9 minutes late, so technician W stored 243 bags of quinine salt under the grey column."
    item = f"Read the passage below and answer the question.\n\n{passage}\n\nQuestion: what should the night warden do next?"
    words = passage.split()
    docs = [
        (1, "Before. " + passage + " After."), (2, " ".join(words[:12]).upper().replace(" ", "\n")), (3, " ".join(words[:11])), (4, "Read the passage below and answer the question. Question: what should the night warden do next?"),
        (5, None), (6, ""), (7, "word " * 30_000 + " ".join(words[4:17])), (8, passage + " and again " + passage), (9, passage.replace("o", "о")), (10, "Trolley 22 reached"),
    ]
    documents = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0))
    items = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")
    assert {tuple(r) for r in leakage.leaked_documents(documents, items).collect()} == {(d, 7) for d in (1, 2, 7, 8, 9)}
    spans = leakage.removal_spans(documents, items).where("doc_id = 8").orderBy("span_start").collect()
    assert [(s.span_start, s.items) for s in spans] == [(0, "7"), (24, "7")]
    assert leakage.leaked_documents(documents, items.limit(0)).count() == 0 and leakage.leaked_documents(documents.limit(0), items).count() == 0


def test_a_corpus_is_indexed_once_and_asked_again(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 200))) for _ in range(60)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = leakage.CorpusIndex(spark, str(tmp_path / "index"))
    index.add(documents.where("doc_id < 40"), "first")
    index.add(documents.where("doc_id >= 40"), "second")
    del documents
    for seed in (1, 2):  # another test set needs no documents
        rng = random.Random(seed)
        quoted = {k: d for k, d in enumerate(rng.sample([i for i, t in enumerate(texts) if len(t.split()) > 40], 12))}
        items = [(k, "Instruction.\n\n" + " ".join(texts[d].split()[5:25]) + "\n\nQuestion?") for k, d in quoted.items()]
        found = index.search(spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {(r.item_id, r._key, r.span_start, r.span_end) for r in found} == {(k, d, 5, 25) for k, d in quoted.items()}
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 2000)  # many blocks of phrases, the same spans
    again = index.search(spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_stretches_of_a_long_document_lose_no_phrase(monkeypatch):
    monkeypatch.setattr(leakage, "SHARD_CHARS", 120)
    text = " ".join(f"w{i}-x" if i % 7 == 0 else f"w{i}" for i in range(300))
    parts = [p for word in leakage.split_words(text) for p in word]
    pieces = list(leakage._pieces(text, 12))
    assert len(pieces) > 5 and all(parts[first : first + len(held)] == held for first, held in pieces)
    grams = {tuple(p for word in leakage.split_words(text)[i : i + 12] for p in word) for i in range(289)}
    held = {tuple(piece[i : i + n]) for _, piece in pieces for n in (12, 13, 14) for i in range(len(piece) - n + 1)}
    assert grams <= held


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
def test_slots_are_permuted(n):
    keys = np.full(n, 12345, np.uint64)
    out = mixing.permuted(np.arange(n), np.full(n, n), keys)
    assert sorted(out.tolist()) == list(range(n))
    assert n < 90 or (mixing.permuted(np.arange(n), np.full(n, n), keys + np.uint64(1)) != out).mean() > 0.9
    steps = np.diff(out)
    assert n < 90 or len(np.unique(steps)) > n // 4  # no fixed step


def test_shards_are_drawn_apart_and_blocks_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_SHARDS", 7)
    sizes = {"a": 4000, "b": 2500, "c": 3, "d": 0}
    blocks = spark.createDataFrame([("m", s, n) for s, n in sizes.items()] + [("n", "a", 65)], "mix_name string, source string, blocks long")
    dealt = mixing.dealt_slots(blocks).toPandas()
    for (mix, source), rows in dealt.groupby(["mix_name", "source"]):
        slots = sorted(k for first, n in rows[["first_slot", "slots"]].itertuples(index=False) for k in range(first, first + n))
        assert slots == list(range(rows["blocks"].iloc[0]))
    per_shard = dealt[dealt.mix_name == "m"].groupby("shard_no").slots.sum()
    assert (per_shard.iloc[:-1] == mixing.SHARD_BLOCKS).all() and per_shard.sum() == 6503
    share = dealt[(dealt.mix_name == "m") & (dealt.source == "a")].groupby("shard_no").slots.sum() / mixing.SHARD_BLOCKS
    assert 0.03 < share.std() < 0.12  # multinomial counts: about the square root of 0.6 * 0.4 / 64


def test_blocks_are_full_and_documents_are_carried_over(spark):
    rng = random.Random(1)
    docs = [(i, "word " * rng.choice([3, 90, 700, 6000]), "big" if i % 3 else "small") for i in range(300)]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "big", 0.5, 1, 0.8), ("m", "small", 0.5, 2, 0.8)], "mix_name string, source string, target_share double, max_repeats int, budget_ratio double")
    pieces = mixing.mix_blocks(documents, targets).toPandas()
    pieces["size"] = pieces.to_token - pieces.from_token
    for (mix, source), rows in pieces.groupby(["mix_name", "source"]):
        held = rows.groupby("block")["size"].sum().sort_index()
        assert (held.iloc[:-1] == mixing.BLOCK_TOKENS).all() and list(held.index) == list(range(len(held)))
        for _, block in rows.sort_values("offset").groupby("block"):
            assert (block.offset.iloc[1:].to_numpy() == (block.offset + block["size"]).iloc[:-1].to_numpy()).all() and block.offset.iloc[0] == 0
    whole = mixing.mix_documents(documents, targets).toPandas()
    carried = pieces.groupby(["mix_name", "source", "doc_id", "copy_no"])["size"].sum().to_dict()
    assert carried == {(r.mix_name, r.source, r.doc_id, r.copy_no): r.tokens for r in whole.itertuples()}


def test_mixing(spark):
    rng = random.Random(1)
    docs = [(i, "word " * rng.randrange(20, 120), "big" if i % 3 else "small") for i in range(3000)] + [(9001, None, "big"), (9002, "x", None), (9003, "", "big")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("m", "big", 0.5, 1, 0.8), ("m", "small", 0.5, 2, 0.8), ("n", "small", 1.0, 2, 3.0), ("n", "none", 0.0, 1, 3.0)], "mix_name string, source string, target_share double, max_repeats int, budget_ratio double")
    mix = mixing.mix_documents(documents, targets).toPandas()
    assert not mix.duplicated(["mix_name", "doc_id", "copy_no"]).any()
    assert mix.groupby(["mix_name", "source"]).copy_no.max().to_dict() == {("m", "big"): 1, ("m", "small"): 2, ("n", "small"): 2}
    report = {(r.mix_name, r.source): r for r in mixing.mix_report(documents, targets).collect()}
    assert abs(report["m", "big"].actual_share - 0.5) < 0.002 and abs(report["m", "small"].actual_share - 0.5) < 0.002
    assert report["n", "small"].chosen == 2 * report["n", "small"].held and report["n", "none"].chosen == 0
    again = mixing.mix_documents(documents, targets).toPandas()
    assert sorted(map(tuple, mix.values)) == sorted(map(tuple, again.values))
    assert mixing.mix_documents(documents.limit(0), targets).count() == 0


def test_lookalikes(spark):
    docs = [
        (1, "A café at 5 °C, office"), (2, "Ａ café at 5 °C, oﬃce"), (3, "А саfé at​ 5 °C, office"), (4, "A café at 5 °C, office"), (5, "A cafe at 5 °C, office"), (6, "A café at ⁵ °C, office"), (7, "a café at 5 °C, office"), (8, None), (9, ""), (10, "  "), (11, "x​" * 20_000), (12, "x" * 20_000),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("form", F.lit("clash")).withColumn("_key", F.lit(0))
    pairs = {tuple(r) for r in lookalike.lookalike_pairs(df).collect()}
    assert pairs == {(1, 2), (1, 3), (1, 4)} - {(1, 4)} | {(2, 3), (2, 4), (3, 4), (9, 10), (11, 12)}
    classes = {r.doc_id: (r.class_id, r.variants) for r in lookalike.lookalike_classes(df).collect()}
    assert classes[4] == (1, 3) and classes[5] == (5, 1) and 8 not in classes
    forms = {r.doc_id: r.form for r in lookalike.consistent_text(df.select("doc_id", "text")).collect()}
    assert forms[3] == forms[1] and forms[8] is None and forms[10] == ""
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0


def test_a_limit_outweighs_an_abbreviation(spark):
    fill = lambda n, end: "A" + "b" * (n - len(end) - 1) + end
    rows = [(i, "limited", fill(250, " mid")) for i in range(200)] + [(300 + i, "limited", fill(100 + i, " whole.")) for i in range(100)]
    weak = [" e.g.", " cf.", " by J.", " at 3."]
    rows += [(1000 + i, "limited", fill(250, end)) for i, end in enumerate(weak)] + [(2000 + i, "limited", fill(180, end)) for i, end in enumerate(weak)] + [(3000, "limited", fill(250, " whole."))]
    df = spark.createDataFrame(rows, "paper_id long, source string, abstract string")
    assert {r.paper_id for r in truncation.truncated(df).collect()} - set(range(200)) == {1000, 1001, 1002, 1003}
