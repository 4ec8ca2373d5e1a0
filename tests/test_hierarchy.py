import random

from tallywright.operators import hierarchy as h

EDGES = "capture_id string, row_order int, parent_row_order int, row_path string, normalized_item string"


def brute(edges):
    parent = {(c, r): p for c, r, p, *_ in edges}
    cycles, depth = set(), {}
    for node in parent:
        seen, at, d = [], node, 0
        while at in parent and parent[at] is not None and (at[0], parent[at]) in parent and at not in seen:
            seen.append(at)
            at, d = (at[0], parent[at]), d + 1
        if at in seen:
            if at == node:
                cycles.add(node)
        else:
            depth[node] = d
    return cycles, depth


def test_against_walk(rows):
    rng = random.Random(5)
    edges = []
    for c in ("hot", "hot2", "small"):
        n = {"hot": 150, "hot2": 60, "small": 5}[c]
        for r in range(n):
            p = rng.choice([None, r - 1 if r else None, rng.randrange(n), rng.randrange(max(r, 1)), 900])
            edges.append((c, r, p, "stale", f"i{r}"))
    edges += [("self", 1, 1, None, "x"), ("two", 1, 2, None, "a"), ("two", 2, 1, None, "b"), ("two", 3, 1, None, "below")]
    df = rows(EDGES, *edges, *edges[:20])
    cycles, depth = brute(edges)
    assert {(r.capture_id, r.row_order) for r in h.rows_on_cycles(df).collect()} == cycles
    paths = {(r.capture_id, r.row_order): r for r in h.resolve_paths(df).collect()}
    assert len(paths) == len(edges)
    for k, r in paths.items():
        assert r.depth == depth.get(k) and (r.status == "CYCLE") == (k not in depth)
    assert paths[("two", 3)].status == "CYCLE" and ("two", 3) not in cycles


def test_long_chain_path_and_descendants(rows):
    df = rows(EDGES, *[("c", i, i - 1 if i else None, None, f"n{i}") for i in range(70)])
    p = h.resolve_paths(df)
    last = p.where("row_order = 69").first()
    assert last.depth == 69 and last.root == 0 and last.full_path == " / ".join(f"n{i}" for i in range(70))
    assert h.descendants(p).count() == 69 * 70 // 2
    assert h.descendant_counts(p).where("row_order = 0").first().n_below == 69


def test_nulls_orphans_empty(rows):
    df = rows(EDGES, ("c", 1, 99, None, None), ("c", None, 1, None, "x"), (None, 1, None, None, "x"), ("c", 2, 1, None, "b"))
    got = {r.row_order: r for r in h.resolve_paths(df).collect()}
    assert got[1].status == "ORPHAN_TOP" and got[2].full_path == " / b" and len(got) == 2
    assert h.rows_on_cycles(rows(EDGES)).count() == 0 and h.resolve_paths(rows(EDGES)).count() == 0
