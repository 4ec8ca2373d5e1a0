import gc
import random
import weakref

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywright.llm import leaks, mixing, reading_level as rl
from tallywright.llm.tokens import pieces, stream

DOCS = "doc_id long, text string, source string, s_scale string"


def test_stream_does_not_depend_on_the_batch():
    texts = ["收入 1,234万元 Net Profit", "", None, "ＮＥＴ profit\n收入", "a" * 50]
    whole, alone = stream(texts), [stream([t]) for t in texts]
    assert list(whole.hashes) == [h for s in alone for h in s.hashes]
    assert [len(p) for _, p in pieces(["x" * 25, "y"], 10)] and sum(len("".join(p)) for _, p in pieces(["x" * 25, "y"], 10)) == 26


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_index_against_plain_search(n):
    rng = np.random.default_rng(n)
    symbols = np.concatenate([rng.integers(1, 5, n) + 1, [0]])
    text = symbols.tolist()
    assert leaks.suffix_array(symbols).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    index = leaks.FMIndex(symbols)
    for size in (1, 2, 4):
        phrases = np.minimum(rng.integers(2, 6, (15, size)), symbols.max())
        low, high = index.search(phrases)
        for p, a, b in zip(phrases.tolist(), low, high):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text) - size + 1) if text[i : i + size] == p]


def test_repeats_do_not_stop_the_suffix_array():
    s = np.concatenate([np.tile([2, 3, 4, 1], 300), [0]])
    text = s.tolist()
    assert leaks.suffix_array(s).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


ZH = "岚津盐场项目在第30周出险，核定损失1615元，免赔23%，由2家共保人分担。去年雾洲共有147户投保，退出72户，新入户数恰为退出户数的7倍。勘查员在朔浦记录了32处破损，其中3处早于起保日，折旧年限取8年。"
EN = "The pool gives its Tarnfell leader 60 percent, splits the rest among 5 followers and books the remainder to the lighthouse account. An inspector in Brannock Sound listed 40 cracks, 2 of them older than the cover, and chose 5 years of wear."
OTHER = ZH.replace("30", "12").replace("1615", "94").replace("23", "8").replace("147", "51").replace("72", "30").replace("7倍", "4倍").replace("32", "77").replace("岚津", "雾洲").replace("3处早", "9处早").replace("8年", "6年").replace("2家", "5家")


def test_leaks(spark):
    rng = random.Random(0)
    filler = "".join(rng.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张") for _ in range(400))
    wide = "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in ZH)
    misread = EN.replace("leader", "leoder").replace("remainder", "remoinder").replace("cracks", "crocks").upper()
    docs = [(1, filler + ZH + filler), (2, filler), (3, OTHER), (4, wide[10:70] + "\n" + filler), (5, misread.replace(" ", "\n")), (6, ZH[:25] + filler), (7, None), (8, ""), (9, ZH), (10, ZH), (11, ZH[:50] + filler + ZH[50:]), (12, "Choose the most appropriate answer.")]
    df = spark.createDataFrame([(i, t, None, "x") for i, t in docs], DOCS)
    items = spark.createDataFrame([(71, ZH), (72, ZH), (73, EN), (74, None), (75, ""), (76, "??")], "item_id long, passage string")
    found = leaks.leaked_items(df, items)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == {(d, i) for d in (1, 4, 9, 10, 11) for i in (71, 72)} | {(5, 73)}
    spans = {(r.doc_id, r.span_start, r.span_end) for r in leaks.removal_spans(found).collect()}
    assert (1, 400, 400 + len(ZH) - 1) in spans and len([s for s in spans if s[0] == 11]) == 2
    assert leaks.leaked_items(df.limit(0), items).count() == 0 and leaks.leaked_items(df, items.limit(0)).count() == 0


def test_share_is_measured_on_the_text():
    numbers = "岚津盐场历年赔款依次为" + "与".join(str(71935046 + 8642097 * k) for k in range(6)) + "元"
    rest = "勘查员随后逐一走访了沿岸全部渔户并把所见破损与修缮情形写入年度报告供各家共保人核对"
    passage, document = leaks.tokenise([numbers + "。" + rest, "天地玄黄" + numbers + "宇宙洪荒"])
    share, _ = leaks.held_share(passage, document)
    assert abs(share - len(numbers) / len(numbers + rest)) < 1e-9 and share > 0.6


def test_signs_inside_numbers_are_layout():
    before, after = "共保体约定澜屏首席承担百分之六十二余下均摊由于老客户续保意愿提高准备金余额回升到", "万元岚津冰库的自留比例原为七成九第四季度起每季提高两个百分点尾差归入冰库账户"
    for written in ("64155.08", "６４，１５５．０８", "64 155,08", "6415508"):
        passage, document = leaks.tokenise([before + "64,155.08" + after, "天地玄黄" + before + written + after])
        assert leaks.held_share(passage, document)[0] == 1.0
        head = leaks.tokenise([before[-12:] + written + after[:14]])[0]
        assert leaks.held_share(leaks.tokenise([before[-12:] + "64,155.08" + after[:14]])[0], head)[0] == 1.0


def test_short_stretches_in_any_order():
    filler = ["天地玄黄宇宙洪荒日月盈昃辰宿列张", "寒来暑往秋收冬藏闰余成岁律吕调阳", "云腾致雨露结为霜金生丽水玉出昆冈", "剑号巨阙珠称夜光果珍李柰菜重芥姜"]
    filler = [f + g for f, g in zip(filler, filler[1:] + filler[:1])]
    quarter = len(ZH) // 4
    parts = [ZH[k * quarter : k * quarter + int(quarter * 0.7)] for k in range(4)]
    half = len(ZH) // 2
    passage, apart, backwards, swapped, same_make = leaks.tokenise([ZH, "".join(f + p for f, p in zip(filler, parts)), "".join(f + p for f, p in zip(filler, parts[::-1])), ZH[half:] + filler[0] + ZH[:half], OTHER])
    for document in (apart, backwards):
        share, spans = leaks.held_share(passage, document)
        assert 0.6 < share < 0.8 and len(spans) == 4
    assert leaks.held_share(passage, swapped)[0] > 0.95
    assert leaks.held_share(passage, same_make)[0] < leaks.LEAST_SHARE


def test_leaks_over_many_small_shards_and_short_passages(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"甲乙丙丁{i} 戊己庚辛", None, "x") for i in range(40)], DOCS).coalesce(1)
    items = spark.createDataFrame([(1, "丁7 戊己庚"), (2, "没有这个")], "item_id long, passage string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(df, items).collect()} == {(7, 1)}


@pytest.mark.parametrize("every", [7, 9, 12])
def test_misread_characters_do_not_hide_a_case(every):
    rng = random.Random(every)
    common, other = ("".join(rng.choice("保险合同准备金资产负债现金流量计量确认") for _ in range(3000)) for _ in range(2))
    missed = 0
    for k in range(40):
        passage = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60)) + common[k * 60 : k * 60 + 60]
        at = rng.randrange(0, 46)
        held = "".join(chr(0x7000 + rng.randrange(2000)) if i % every == every - 1 else c for i, c in enumerate(passage[at : at + 75]))
        wanted, docs = leaks.prepare([passage]), leaks.tokenise([other[: rng.randrange(500)] + held + other[500:900], other[900:1500]])
        found = [(d, p) for d, p in leaks.Shard(docs).candidates(wanted) if leaks.share_of(wanted.tokens[p], leaks.held_parts(wanted.tokens[p], docs[d], wanted.needed[p])) >= leaks.LEAST_SHARE]
        missed += found != [(0, 0)]
    assert missed == 0


def test_many_symbols():
    rng = np.random.default_rng(1)
    symbols = np.concatenate([rng.permutation(2**21 + 40) + 1, [0]])  # more than 21 bits
    assert (leaks.suffix_array(symbols)[symbols] == np.arange(len(symbols))).all()


def test_long_document_is_searched_in_pieces(monkeypatch):
    rng = random.Random(3)
    filler = lambda n: "".join(rng.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往") for _ in range(n))
    half = len(ZH) // 2
    text = filler(9_900) + ZH[:half] + filler(20_000) + ZH[half:] + filler(9_970) + EN + filler(500)
    monkeypatch.setattr(leaks, "SHARD_TOKENS", 10_000)
    tokens = leaks.tokenise([text])[0]
    got = leaks._search_long([5, 6], text, tokens, [(0, leaks.prepare([ZH, OTHER])), (2, leaks.prepare([EN]))])
    assert sorted(zip(got.doc_id, got.passage)) == [(5, 0), (5, 2), (6, 0), (6, 2)] and (got.share > 0.9).all()
    spans = got[(got.doc_id == 5) & (got.passage == 2)].spans.iloc[0]
    assert text[spans[0]["start"] : spans[-1]["end"]] == EN.rstrip(".")


def test_nothing_of_a_searched_shard_stays():
    docs = leaks.tokenise([ZH, EN, OTHER])
    kept = [weakref.ref(t.hashes.base) for t in docs]
    got = leaks._search_shard([[1], [2], [3]], [ZH, EN, OTHER], docs, [(0, leaks.prepare([ZH, EN]))])
    long = leaks._search_long([4], ZH, docs[0], [(0, leaks.prepare([ZH]))])
    assert set(zip(got.doc_id, got.passage)) == {(1, 0), (2, 1)} and list(long.doc_id) == [4]
    del docs
    gc.collect()
    assert not any(k() is not None for k in kept)


def test_many_passages(spark, monkeypatch):
    rng = random.Random(4)
    passages = ["".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(40)) for _ in range(50_000)]
    docs = spark.createDataFrame([(i, "甲" + passages[i * 7] + "乙", None, "x") for i in range(200)], DOCS)
    monkeypatch.setattr(leaks, "PASSAGE_CHARS", 4_000_000)  # two searches
    items = spark.createDataFrame([(i, p) for i, p in enumerate(passages)], "item_id long, passage string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(docs, items).collect()} == {(i, i * 7) for i in range(200)}


def test_cuts_of_long_texts_change_no_token():
    text = "".join("第%d条 the café résumé 1,234.5%%。" % k for k in range(400))
    whole = stream([text]).hashes.tolist()
    for most in (50, 333, 1000):
        assert [h for _, part in pieces([text], most) for h in stream(part).hashes.tolist()] == whole
        assert "".join(t for _, part in pieces([text], most) for t in part) == text


def test_mixture(spark):
    rng = random.Random(2)
    docs = [(i, "word " * rng.randrange(5, 60), "big" if i % 3 else "small", "x") for i in range(1500)] + [(9001, "stray " * 50, None, "x"), (9002, "", "big", "x"), (9003, None, "big", "x")]
    df = spark.createDataFrame(docs, DOCS)
    t = "mix_id string, size_ratio double, source string, target_share double, max_repeats int"
    targets = spark.createDataFrame([("m", 0.5, "big", 0.6, 1), ("m", 0.5, "small", 0.4, 2), ("n", 2.0, "small", 0.9, 3), ("n", 2.0, "none", 0.1, 9), ("o", 1.0, "big", 1.0, 1)], t)
    filled, blocked, sized = mixing.plan_mixes(df, targets, block_tokens=200)
    rows = {(r.mix_id, r.source): r for r in mixing.share_report(filled, sized, targets).collect()}
    total = sized.agg({"tokens": "sum"}).first()[0]
    assert abs(rows["m", "big"].reached_share - 0.6) < 0.02 and abs(rows["m", "small"].reached_share - 0.4) < 0.02
    small = sized.where("source = 'small'").agg({"tokens": "sum"}).first()[0]
    assert rows["n", "small"].reached_tokens == min(3 * small, rows["n", "small"].reached_tokens) and not rows["n", "small"].reachable and rows["n", "none"].reached_tokens == 0
    assert not rows["o", "big"].reachable and rows["o", "big"].reached_tokens == sized.where("source = 'big'").agg({"tokens": "sum"}).first()[0]
    m = mixing.mixture(filled, blocked)
    per = m.groupBy("mix_id", "source", "doc_id").agg(F.countDistinct("repeat").alias("count")).groupBy("mix_id", "source").agg({"count": "max"}).collect()
    assert {(r[0], r[1]): r[2] for r in per} == {("m", "big"): 1, ("m", "small"): 1, ("n", "small"): 3, ("o", "big"): 1}
    assert m.where("mix_id = 'm'").agg({"tokens": "sum"}).first()[0] == rows["m", "big"].reached_tokens + rows["m", "small"].reached_tokens and total > 0
    early = filled.where("mix_id = 'm' AND slot < 40").groupBy("source").count().collect()
    assert abs({r.source: r["count"] for r in early}["big"] / 40 - 0.6) < 0.1  # every prefix keeps the shares
    empty = mixing.plan_mixes(df.limit(0), targets)
    assert mixing.share_report(empty[0], empty[2], targets).where("reached_tokens > 0").count() == 0


def test_blocks_are_equal_and_hold_every_token(spark):
    df = spark.createDataFrame([(i, "s", 1 + i % 90) for i in range(3000)] + [(9000 + i, "long", 400_000) for i in range(3)], "doc_id long, source string, tokens long")
    b = mixing.blocks(df, 500)
    held = {r.doc_id: (r.n, r.first) for r in b.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.min("from_token").alias("first")).collect()}
    assert held == {r.doc_id: (r.tokens, 0) for r in df.collect()}
    sizes = {(r.source, r.block): (r.n, r.at) for r in b.groupBy("source", "block").agg(F.sum("tokens").alias("n"), F.min("at").alias("at")).collect()}
    for source, total in (("s", sum(1 + i % 90 for i in range(3000))), ("long", 1_200_000)):
        n = -(-total // 500)
        assert [sizes[source, k] for k in range(n)] == [(500, 0)] * (n - 1) + [(total - 500 * (n - 1), 0)]


def test_shares_of_long_documents_are_met(spark):
    df = spark.createDataFrame([(1, "a", 400_000), (2, "a", 399_000), (3, "a", 401_300), (4, "b", 30_000), (5, None, 5000), (6, "c", 10_001)], "doc_id long, source string, tokens long")
    t = spark.createDataFrame([("m", 0.5, "a", 0.5, 1), ("m", 0.5, "b", 0.1, 3), ("m", 0.5, "c", 0.4, 30), ("edge", 1.0, "c", 10_001.0 * 5 / 1_245_301, 5), ("over", 1.0, "c", 10_001.2 * 5 / 1_245_301, 5)], "mix_id string, size_ratio double, source string, target_share double, max_repeats int")
    total = 1_245_301
    filled = mixing.filled_slots(mixing.schedule(spark, t, total, {"a": 1_200_300, "b": 30_000, "c": 10_001}), df, t, total)
    rows = {(r.mix_id, r.source): r for r in mixing.share_report(filled, df, t).collect()}
    for r in rows.values():
        assert (r.reached_tokens >= r.target_tokens) == r.reachable
        assert abs(r.reached_tokens - r.target_tokens) < 1 if r.reachable else r.reached_tokens == r.available_tokens
    assert rows["edge", "c"].reachable and not rows["over", "c"].reachable
    used = mixing.mixture(filled, mixing.blocks(df)).groupBy("mix_id", "source").agg(F.sum("tokens").alias("n")).collect()
    assert {(r.mix_id, r.source): r.n for r in used} == {k: r.reached_tokens for k, r in rows.items()}


def test_pieces_of_long_texts_give_the_same_tokens():
    import base64

    import tiktoken

    with open(mixing.DEFAULT_TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    encoder = tiktoken.Encoding("public", pat_str=mixing.SPLIT, mergeable_ranks=ranks, special_tokens={})
    text = "It's 1,234 words — 保险合同准备金，资产 負債。\n\n  done " * 200
    for most in (40, 333, 5000):
        cut = mixing.pieces(text, most)
        assert "".join(cut) == text and sum((encoder.encode_ordinary(p) for p in cut), []) == encoder.encode_ordinary(text)


def _text(level, rng):
    easy, hard = "狗 跑 了 。 我 们 很 高 兴 。".split(), "公允价值 计量 模型 项下 之 摊销 残值 予以 递延 ， 惟 其 交互 影响 须 另行 披露".split()
    words = [rng.choice(hard if rng.random() < (level - 1) / 4 else easy) for _ in range(60)]
    return "".join(words) + "。"


def test_reading_levels(spark):
    rng = random.Random(3)
    data = [(i, _text(1 + i % 5, rng), None, "x") for i in range(400)] + [(900, "", None, "x"), (901, None, None, "x"), (902, "1,204  88 —", None, "x"), (903, "n/a", None, "x")]
    df = spark.createDataFrame(data, DOCS)
    labels = spark.createDataFrame([(i, "g", 1 + i % 5) for i in range(0, 300)] + [(900, "g", 3)], "doc_id long, grader string, reading_level int")
    got = {r.doc_id: r for r in rl.reading_levels(df, rl.fit_model(df, labels)).collect()}
    assert len(got) == 404 and all(got[i].level is None and got[i].score is None for i in (900, 901, 902, 903))
    held = [got[i].level - (1 + i % 5) for i in range(300, 400)]
    assert sum(map(abs, held)) / 100 < 0.6 and sum((got[i].level >= 4) == (1 + i % 5 >= 4) for i in range(300, 400)) >= 90
    again = {r.doc_id: r.level for r in rl.reading_levels(df.repartition(7), rl.fit_model(df.repartition(3), labels)).collect()}
    assert again == {k: v.level for k, v in got.items()}
    few = rl.fit_model(df, labels.limit(2))
    assert {r.level for r in rl.reading_levels(df.where("doc_id < 5"), few).collect()} and rl.reading_levels(df.limit(0), few).count() == 0


def test_isotonic_is_monotone_and_close():
    rng = np.random.default_rng(0)
    x = np.sort(rng.normal(size=200))
    y = x + rng.normal(scale=0.5, size=200)
    knots, levels = rl.isotonic(x, y)
    assert (np.diff(levels) >= -1e-12).all() and (np.diff(knots) >= 0).all()
    assert abs(np.interp(x, knots, levels).mean() - y.mean()) < 0.05


def test_scores_equal_the_matrix():
    texts = ["收入增长。利润 下降。", "A long sentence, with clauses; and numbers 12.", ""]
    w = np.random.default_rng(1).normal(size=rl.VOCABULARY + rl.SYNTAX)
    x, ok = rl.features(texts)
    assert np.allclose(rl.scores(texts, w)[ok], x[ok] @ w, atol=1e-4) and list(ok) == [True, True, False]
    assert pd.isna(rl.scores(texts, w)[2])


def test_level_of_a_long_text_does_not_depend_on_its_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    text = "".join(f"第{k}条 本集团于{k % 97}年确认 the reserve of {k}.5%。" + ("\n" if k % 5 == 0 else "") for k in range(3000))
    weights = rng.normal(size=rl.VOCABULARY + rl.SYNTAX)
    whole, matrix = rl.scores(["短句子在此。", text, ""], weights), rl.features(["短句子在此。", text, ""])[0]
    cut = pieces
    for most in (1000, 7777):
        monkeypatch.setattr(rl, "pieces", lambda texts: cut(texts, most))
        assert np.allclose(rl.scores(["短句子在此。", text, ""], weights), whole, rtol=1e-12, equal_nan=True)
        assert np.allclose(rl.features(["短句子在此。", text, ""])[0], matrix)
