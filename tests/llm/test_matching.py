import itertools
import random

import pytest

from tallywright.llm import entry_match as em
from tallywright.llm import name_groups as ng
from tallywright.llm.variants import deletion_variants, weighted_distance
from tallywright.session import Workspace

METRICS = "metric_id string, canonical_name string, aliases array<string>, soft_aliases array<string>, exclude array<string>"


def osa(a, b):
    d = {(i, j): i + j if not i * j else 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_distance_and_keys_by_brute_force():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 14))) for _ in range(120)]
    for a, b in itertools.combinations(words, 2):
        want, got = osa(a, b), weighted_distance(a, b, 2)
        assert (got[0] if got else 3) == min(want, 3)
        if want <= 2:
            assert set(deletion_variants(a, 2)) & set(deletion_variants(b, 2)), (a, b)


def test_matching(spark):
    metrics = spark.createDataFrame([("M1", "营业收入", ["经营总收入", "operating income"], ["业务收入"], ["营业外利得"]), ("M2", "应收保费净额", ["premiums receivable net"], ["应收保费"], ["应付保费"]), ("M3", "资本公积余额", [], [], ["盈余公积余额"]), ("M4", "盈余公积余额", None, None, None)], METRICS)
    want = {
        "营业收 入": "M1", "【經營總收入】": "M1", "oeprating income": "M1", "查询：营业收入明细": "M1", "营业外利得": "UNMATCHED", "应付保费": "UNMATCHED", "应收保费净额（附注七-12）": "M2", "2021年 应收保保费": "M2", "盈余公积余额": None,
        "盈余公积佘额": "M4", "办公楼平面图": "UNMATCHED", "": "UNMATCHED", "???": "UNMATCHED", "营" * 5000: "UNMATCHED", "营​业收入": "M1",
    }
    data = [("table_query", f"c{i}", t) for i, t in enumerate([*want, None])] + [("table_query", "again", "营业收 入")] * 2
    records = spark.createDataFrame(data, "source_field string, record_id string, text string")
    names = metrics.selectExpr("'table_query' AS source_field", "canonical_name AS text")
    terms = em.reference_terms("table_query", metrics, "metric_id", "canonical_name", "aliases", "soft_aliases", "exclude")
    rows = em.match_records(records, terms, names).collect()
    got = {r.text: r.ref_id for r in rows}
    assert got == {k: v for k, v in want.items() if v} and sum(r.record_id == "again" for r in rows) == 2
    assert em.match_records(records.limit(0), terms, names).count() == 0


@pytest.mark.parametrize(
    "name, root, line",
    [("桂缎澜嘉健康保险股份有限公司", "桂缎澜嘉", "health"), ("财产保险有限公司（湖桥诺霜）", "湖桥诺霜", "property"), ("再保-画鉴曦菊", "画鉴曦菊", "reinsurance"), ("思恭沙岚人寿保险有限公可", "思恭沙岚", "life"), ("雄玉黛凯", "雄玉黛凯", None), ("永蔚汇健保险", "永蔚汇健", None),
     ("general insurance, binfermepir inc.", "binfermepir", "general"), ("binfermepir reinsuraace plc", "binfermepir", "reinsurance"), ("legapete re", "legapete", "reinsurance")],
)
def test_name_parts(name, root, line):
    assert ng.split_name(name) == (root, line)


def test_grouping(spark):
    a = [("p1", "s1", "桂缎澜嘉健康保险股份有限公司"), ("p2", "s2", "桂缎澜嘉人寿保险有限公司"), ("p3", "s3", "桂缎健康"), ("p4", "s4", "杨缎澜嘉健康"), ("p5", "s5", "Getrefodan Reinsurance Holdings Limited"), ("p6", "s6", None), ("p7", "s7", " "), ("p8", "s5", "getrefodan re hldgs ltd"), ("p9", "s1", "桂缎澜嘉健康保险股份有限公司")]
    c = [("p1", "昌安系医护"), ("p2", "昌安系人身"), ("p1", "桂缎澜嘉"), (None, "Getrefodna Re"), ("p5", None)]
    assets = spark.createDataFrame(a, "pdf_id string, sha256 string, company string")
    captures = spark.createDataFrame(c, "pdf_id string, company string")
    groups = {}
    for r in ng.group_names(assets, captures).collect():
        groups.setdefault(r.cluster, set()).add(r["name"])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, [{"桂缎澜嘉健康保险股份有限公司", "桂缎健康", "杨缎澜嘉健康", "昌安系医护", "桂缎澜嘉"}, {"桂缎澜嘉人寿保险有限公司", "昌安系人身"}, {"Getrefodan Reinsurance Holdings Limited", "getrefodan re hldgs ltd", "Getrefodna Re"}]))
    pairs = ng.same_organisation(ng.group_names(assets, captures))
    assert pairs.count() == 10 + 1 + 3 and pairs.where("name_a >= name_b").count() == 0
    assert ng.group_names(assets.limit(0), captures.limit(0)).count() == 0


def test_average_linkage_like_the_sequential_one(spark):
    rng = random.Random(4)
    nodes = [(f"n{i:02d}", rng.choice([1, 1, 2, 9])) for i in range(24)]
    edges = [(a[0], b[0], round(rng.uniform(0.2, 1), 6)) for a, b in itertools.combinations(nodes, 2) if rng.random() < 0.4]
    size, total, members = dict(nodes), {}, {n: {n} for n, _ in nodes}
    for a, b, s in edges:
        total[frozenset((a, b))] = s * size[a] * size[b]
    while total:
        key, s = max(((k, v / (size[min(k)] * size[max(k)])) for k, v in total.items()), key=lambda x: x[1])
        if s < 0.34:
            break
        a, b = sorted(key)
        members[a] |= members.pop(b)
        for k in [k for k in total if b in k]:
            (other,) = k - {b}
            v = total.pop(k)
            if other != a:
                total[frozenset((a, other))] = total.get(frozenset((a, other)), 0) + v
        size[a] += size.pop(b)
    got = {}
    df = ng.average_linkage(spark.createDataFrame(nodes, "id string, n long"), spark.createDataFrame(edges, "a string, b string, cosine double"), 0.34, Workspace(spark, "t"))
    for r in df.collect():
        got.setdefault(r.cluster, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, members.values()))


def test_prefix_join_loses_no_pair(spark):
    import math

    rng = random.Random(6)
    roots = ["".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(4)) for _ in range(60)]
    forms = sorted({("life|" + r, "life", r) for r in roots})
    grams = {f: set(ng.ngrams(r)) for f, _, r in forms}
    df = {}
    for g in grams.values():
        for x in g:
            df[x] = df.get(x, 0) + 1
    weight = {x: 1 + math.log(len(forms) / n) for x, n in df.items()}
    norm = {f: math.sqrt(sum(weight[x] ** 2 for x in g)) for f, g in grams.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(grams), 2) if sum(weight[x] ** 2 for x in grams[a] & grams[b]) / norm[a] / norm[b] >= 0.3}
    got = ng.similar_forms(spark.createDataFrame(forms, "form string, line string, root string"), 0.3, Workspace(spark, "t"))
    assert {(r.a, r.b) for r in got.collect()} == want and want
