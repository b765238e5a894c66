"""Change sets against a plain walk, one change after the other."""

import json
import random

import pytest

from kinspark.operators import changesets

AT, OLD = "2024-02-01 00:00:00", "2020-01-01 00:00:00"
NODE = "node_id long, dna_type string, name string, lineage string, source string, formed_ybp int, tmrca_ybp int, is_backbone boolean, valid_from timestamp, valid_until timestamp"
EDGE = "child_id long, parent_id long, source string, valid_from timestamp, valid_until timestamp"
LINK = "node_id long, variant_id long, valid_from timestamp, valid_until timestamp"
CHANGE = "change_id long, change_type string, node_id long, status string, new_values string"


def tables(spark, nodes, edges, links, changes):
    import datetime

    def when(x):
        return None if x is None else datetime.datetime.fromisoformat(x)

    n = spark.createDataFrame([(i, "Y_DNA", name, None, None, None, None, False, when(OLD), when(until)) for i, name, until in nodes], NODE)
    e = spark.createDataFrame([(c, p, None, when(OLD), when(until)) for c, p, until in edges], EDGE)
    v = spark.createDataFrame([(i, x, when(OLD), when(until)) for i, x, until in links], LINK)
    return n, e, v, spark.createDataFrame([(k, t, i, s, None if x is None else json.dumps(x)) for k, t, i, s, x in changes], CHANGE)


def walk(nodes, edges, links, changes):
    """The same by one change at a time."""
    node = {i: [name, None, until] for i, name, until in nodes}
    edge, link = [[c, p, False, u] for c, p, u in edges], [[i, v, False, u] for i, v, u in links]
    made, after = {}, max(node, default=0)

    def held(i, v):
        return any(r[0] == i and r[1] == v and r[3] is None for r in link)

    for _, kind, i, status, x in sorted(changes, key=lambda c: c[0]):
        if status != "APPROVED":
            continue
        x = x or {}
        if kind == "CREATE":
            after += 1
            node[after] = [x["name"], x.get("formed_ybp"), None]
            p = made[x["parent_placeholder"]] if "parent_placeholder" in x else x.get("parent_haplogroup_id")
            if p is not None:
                edge.append([after, p, True, None])
            for v in x.get("variant_ids", []):
                if not held(after, v):
                    link.append([after, v, True, None])
            if "placeholder" in x:
                made[x["placeholder"]] = after
        elif kind == "UPDATE" and i in node:
            node[i][0], node[i][1] = x.get("name", node[i][0]), x.get("formed_ybp", node[i][1])
        elif kind == "DELETE":
            if i in node:
                node[i][2] = node[i][2] or AT
            for r in edge:
                if i in r[:2] and r[3] is None:
                    r[3] = AT
            for r in link:
                if r[0] == i and r[3] is None:
                    r[3] = AT
        elif kind == "REPARENT":
            for r in edge:
                if r[0] == i and r[3] is None:
                    r[3] = AT
            p = made[x["new_parent_placeholder"]] if "new_parent_placeholder" in x else x.get("new_parent_haplogroup_id", x.get("parent_haplogroup_id"))
            edge.append([i, p, True, None])
        elif kind == "VARIANT_EDIT":
            for v in x.get("add", []):
                if not held(i, v):
                    link.append([i, v, True, None])
            for r in link:
                if r[0] == i and r[1] in x.get("remove", []) and r[3] is None:
                    r[3] = AT

    def told(rows):
        return sorted(((a, b, AT if new else OLD, u) for a, b, new, u in rows), key=str)

    return sorted(((i, *v) for i, v in node.items()), key=str), told(edge), told(link)


def folded(out):
    def text(x):
        return None if x is None else str(x)

    node = sorted(((r["node_id"], r["name"], r["formed_ybp"], text(r["valid_until"])) for r in out["node"].collect()), key=str)
    edge = sorted(((r["child_id"], r["parent_id"], text(r["valid_from"]), text(r["valid_until"])) for r in out["edge"].collect()), key=str)
    link = sorted(((r["node_id"], r["variant_id"], text(r["valid_from"]), text(r["valid_until"])) for r in out["link"].collect()), key=str)
    return node, edge, link


def invented(seed):
    rng = random.Random(seed)
    nodes = [(i, f"N{i}", OLD if i % 9 == 0 else None) for i in range(1, 16)]
    edges = [(i, i // 2, None) for i in range(2, 16)] + [(3, 2, OLD)]
    links = [(i, v, None) for i in range(1, 16) for v in range(2)] + [(4, 7, OLD)]
    changes, made = [], []
    for k in range(1, 60):
        i = rng.randrange(1, 16)
        kind = rng.choice(["CREATE", "CREATE", "UPDATE", "DELETE", "REPARENT", "VARIANT_EDIT", "VARIANT_EDIT", "OTHER"])
        status = rng.choice(["APPROVED"] * 5 + ["REJECTED", "PENDING"])
        x = {}
        if kind == "CREATE":
            x = {"name": f"new{k}", "variant_ids": [rng.randrange(4), 9, 9], "formed_ybp": k} | rng.choice([{}, {"parent_haplogroup_id": i}] + [{"parent_placeholder": p} for p in made[-2:]]) | rng.choice([{}, {"placeholder": -rng.randrange(1, 4)}])
            if status == "APPROVED" and "placeholder" in x:
                made.append(x["placeholder"])
        elif kind == "UPDATE":
            x = rng.choice([{"name": f"renamed{k}"}, {"formed_ybp": k}, {}])
            i = rng.choice([i, 17, 99])
        elif kind == "REPARENT":
            x = rng.choice([{"new_parent_haplogroup_id": rng.randrange(1, 16)}, {"parent_haplogroup_id": 1}, {}] + [{"new_parent_placeholder": p} for p in made[-2:]])
        elif kind == "VARIANT_EDIT":
            x = {"add": [rng.randrange(4) for _ in range(2)], "remove": [rng.randrange(4)]}
        changes.append((k, kind, None if kind == "CREATE" else i, status, x or None))
    return nodes, edges, links, changes


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_walk(spark, seed):
    data = invented(seed)
    # an UPDATE may name a node that a later CREATE makes: it finds none there
    out = changesets.apply_change_set(*tables(spark, *data), AT, "Y_DNA")
    assert folded(out) == walk(*data)
    live = [c for c in data[3] if c[3] == "APPROVED"]
    result = out["result"].first()
    assert (result["created"], result["skipped"]) == (sum(c[1] == "CREATE" for c in live), sum(c[1] == "OTHER" for c in live))
    assert {r["change_id"] for r in out["change"].collect() if r["status"] == "APPLIED"} == {c[0] for c in live}


def test_chain_of_placeholders(spark):
    """Each new node hangs under the one before; one placeholder used again means the later node."""
    changes = [(k, "CREATE", None, "APPROVED", {"name": f"c{k}", "placeholder": -1} | ({"parent_placeholder": -1} if k > 1 else {"parent_haplogroup_id": 1})) for k in range(1, 30)]
    out = changesets.apply_change_set(*tables(spark, [(1, "root", None)], [], [], changes), AT, "Y_DNA")
    assert sorted((r["child_id"], r["parent_id"]) for r in out["edge"].collect()) == [(k + 1, k) for k in range(1, 30)]


@pytest.mark.parametrize("change, problem", [
    ((5, "CREATE", None, "APPROVED", {"name": "x", "parent_placeholder": -7}), "unresolved_placeholder"), ((5, "REPARENT", 1, "APPROVED", {"new_parent_placeholder": -2}), "unresolved_placeholder"),
    ((5, "CREATE", None, "APPROVED", {}), "no_name"), ((5, "DELETE", None, "APPROVED", None), "no_node"), ((5, "CREATE", None, "APPROVED", {"name": "root"}), "name_taken"), ((5, "UPDATE", 2, "APPROVED", {"name": "root"}), "name_taken"),
    ((5, "REPARENT", 2, "APPROVED", {"new_parent_haplogroup_id": 77}), "unknown_parent")])
def test_refused(spark, change, problem):
    # the CREATE of -2 was rejected, that of -7 comes too late
    more = [(1, "CREATE", None, "REJECTED", {"name": "r", "placeholder": -2}), (9, "CREATE", None, "APPROVED", {"name": "late", "placeholder": -7})]
    args = tables(spark, [(1, "root", None), (2, "two", None)], [(2, 1, None)], [], [change, *more])
    with pytest.raises(ValueError, match=f"change 5: {problem}"):
        changesets.apply_change_set(*args, AT, "Y_DNA")


def test_a_set_applies_once(spark):
    args = tables(spark, [(1, "root", None)], [], [], [(1, "CREATE", None, "APPROVED", {"name": "x"})])
    with pytest.raises(ValueError, match="APPLIED"):
        changesets.apply_change_set(*args, AT, "Y_DNA", status="APPLIED")
    with pytest.raises(ValueError, match="no_dna_type"):
        changesets.apply_change_set(*args, AT)
    empty = tables(spark, [], [], [], [])
    assert folded(changesets.apply_change_set(*empty, AT)) == ([], [], [])
