"""Deeply nested records to flat tables by interval labels.

A depth-first traversal numbers every node of a record: `pre` on entry, `post` on exit. A node
contains another exactly when pre < other.pre and other.post < post. The traversal is written as
one array expression per record, in pre-order, so the pre-order number is the array position and
`post = pre + descendants - depth`; the nodes contained in a node are the slice that follows it.
Labelling and linking therefore need no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.session import let

NODE = "array<struct<kind:string,pos:int,depth:int,desc:int,leaf:string,attrs:map<string,string>>>"


@dataclass
class NodeType:
    """One type of node: where its elements lie in the parent element, and what to keep of them."""

    kind: str
    elements: Callable[[Column], Column]
    leaf: Callable[[Column], Column]
    attrs: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    children: list[NodeType] = field(default_factory=list)


def _empty() -> Column:
    return F.array().cast(NODE)


def _subtree(t: NodeType, elem: Column, pos: Column, depth: int) -> Column:
    """Nodes of one element in pre-order; a null element has none."""
    attrs = (
        F.create_map(*[x for k, f in t.attrs.items() for x in (F.lit(k), f(elem).cast("string"))])
        if t.attrs
        else F.lit(None).cast("map<string,string>")
    )

    def with_kids(kids: Column) -> Column:
        me = F.struct(
            F.lit(t.kind).alias("kind"),
            pos.cast("int").alias("pos"),
            F.lit(depth).alias("depth"),
            F.size(kids).alias("desc"),
            t.leaf(elem).alias("leaf"),
            attrs.alias("attrs"),
        )
        return F.concat(F.array(me).cast(NODE), kids)

    return F.when(elem.isNull(), _empty()).otherwise(let(_forest(t.children, elem, depth + 1), with_kids))


def _forest(types: list[NodeType], parent: Column, depth: int) -> Column:
    if not types:
        return _empty()

    def nodes_of(t: NodeType) -> Column:
        return F.coalesce(F.flatten(F.transform(t.elements(parent), lambda e, i: _subtree(t, e, i, depth))), _empty())

    return F.concat(*[nodes_of(t) for t in types])


def label(df: DataFrame, key: str, types: list[NodeType], root: Column) -> DataFrame:
    """(key, nodes): all nodes of each record with their interval labels; the record itself is pre 0."""
    forest = _forest(types, root, 1)
    labelled = F.transform(
        forest,
        lambda n, i: F.struct(
            (i + 1).cast("int").alias("pre"), (i + 1 + n["desc"] - n["depth"]).cast("int").alias("post"), *[n[c].alias(c) for c in ("kind", "pos", "depth", "desc", "leaf", "attrs")]
        ),
    )
    return df.select(F.col(key), labelled.alias("nodes"))


def node_table(nodes: DataFrame, key: str, kind: str) -> DataFrame:
    """Flat table of one node type: key, pre, post, pos, depth, leaf, attrs."""
    keep = F.filter("nodes", lambda n: n["kind"] == kind)
    return nodes.select(key, F.explode(keep).alias("n")).select(key, "n.pre", "n.post", "n.pos", "n.depth", "n.leaf", "n.attrs")


def contained(nodes: DataFrame, key: str, parent: str, child: str) -> DataFrame:
    """Children with their parent by interval containment: key, parent_pre, parent_pos, pre, post, pos, leaf, attrs.

    The nodes inside a parent's interval are the `desc` entries after it, so each parent reads one
    slice; the work is linear in the nodes.
    """
    pairs = F.flatten(
        F.transform(
            F.filter("nodes", lambda n: n["kind"] == parent),
            lambda p: F.transform(
                F.filter(
                    F.slice("nodes", p["pre"] + 1, p["desc"]),
                    lambda c: (c["kind"] == child) & (c["depth"] == p["depth"] + 1) & (c["pre"] > p["pre"]) & (c["post"] < p["post"]),
                ),
                lambda c: F.struct(p["pre"].alias("parent_pre"), p["pos"].alias("parent_pos"), *[c[x].alias(x) for x in ("pre", "post", "pos", "leaf", "attrs")]),
            ),
        )
    )
    return nodes.select(key, F.explode(pairs).alias("x")).select(key, "x.*")


# --- attribution of cases ---------------------------------------------------------------------


def _json_text(txt: Column) -> Column:
    """The text of a JSON value; a JSON string is unwrapped, so text within text becomes that text."""
    return F.get(F.from_json(F.concat(F.lit("["), txt, F.lit("]")), "array<string>"), F.lit(0))


def _json_items(txt: Column) -> Column:
    """Element texts of a JSON array; a lone object is an array of one; anything else has none."""
    t = F.trim(txt)
    listed = F.when(t.startswith("["), t).when(t.startswith("{"), F.concat(F.lit("["), t, F.lit("]")))
    return F.from_json(listed, "array<string>")


SIGHTING = "struct<feed:string,seenat:bigint,tags:array<string>>"
CANDIDATE = f"struct<ip:string,scope:string,origin:string,isprimary:boolean,sightings:array<{SIGHTING}>>"


def raw_candidates(raw: Column) -> Column:
    """array<CANDIDATE> from the JSON text of an attribution, whatever its shape.

    The attribution may lie in an outer object under "attribution"; candidates may be an array, a
    lone object, or either of them as text. Text that isn't JSON, and other shapes, give NULL.
    """

    def field(t: Column, name: str) -> Column:
        return F.get_json_object(t, f"$.{name}")

    def of_text(t: Column) -> Column:
        inner = F.coalesce(_json_text(field(t, "attribution")), field(t, "attribution"), t)
        return let(inner, lambda x: _json_items(field(x, "candidates")))

    def sightings(t: Column) -> Column:
        return F.transform(
            _json_items(field(t, "sightings")),
            lambda s: F.when(
                s.isNotNull(),
                F.struct(field(s, "feed").alias("feed"), field(s, "seenat").try_cast("bigint").alias("seenat"), F.from_json(field(s, "tags"), "array<string>").alias("tags")),
            ),
        )

    return F.transform(
        of_text(_json_text(raw)),
        lambda c: F.when(
            c.isNotNull(),
            F.struct(
                field(c, "ip").alias("ip"),
                field(c, "scope").alias("scope"),
                field(c, "origin").alias("origin"),
                field(c, "isprimary").try_cast("boolean").alias("isprimary"),
                sightings(c).alias("sightings"),
            ),
        ),
    ).cast(f"array<{CANDIDATE}>")


def case_tree(cases: DataFrame, full: bool = False) -> DataFrame:
    """(case_no, nodes) for candidates with their sightings, and members, of each case.

    The structured attribution is taken where present, else the JSON text. Null elements are no
    nodes but keep their place in `pos`; null and empty arrays have no nodes. `full` also keeps the
    scalar fields of each node.
    """
    src = cases.select(
        "case_no",
        F.when(F.col("attribution").isNotNull(), F.col("attribution.candidates").cast(f"array<{CANDIDATE}>"))
        .when(F.col("attributionraw").isNotNull(), raw_candidates(F.col("attributionraw")))
        .alias("candidates"),
        "members",
    )

    def attrs(*names):
        return {n: (lambda e, n=n: e[n]) for n in names} if full else {}

    sighting = NodeType(
        "sighting",
        lambda c: c["sightings"],
        lambda s: F.coalesce(s["feed"], F.lit("")),
        attrs("seenat") | ({"tags": lambda s: F.to_json(s["tags"])} if full else {}),
    )
    candidate = NodeType("candidate", lambda r: r["candidates"], lambda c: F.coalesce(c["ip"], F.lit("")), attrs("scope", "origin", "isprimary"), [sighting])
    member = NodeType("member", lambda r: r["members"], lambda m: m)
    return label(src, "case_no", [candidate, member], F.struct("candidates", "members"))


def case_children(cases: DataFrame) -> DataFrame:
    """case_no, child, pos, subpos, leaf: every non-null candidate, sighting and member.

    A node at the top is followed by the nodes inside its interval, so one pass over the labels gives
    all tables and the text of a record is read once.
    """
    row = lambda child, pos, sub, leaf: F.struct(child.alias("child"), pos.alias("pos"), sub.cast("int").alias("subpos"), leaf.alias("leaf"))

    def with_inner(p: Column) -> Column:
        inside = F.filter(F.slice("nodes", p["pre"] + 1, p["desc"]), lambda c: (c["depth"] == p["depth"] + 1) & (c["pre"] > p["pre"]) & (c["post"] < p["post"]))
        return F.concat(F.array(row(p["kind"], p["pos"], F.lit(-1), p["leaf"])), F.transform(inside, lambda c: row(c["kind"], p["pos"], c["pos"], c["leaf"])))

    tops = F.filter("nodes", lambda n: n["depth"] == 1)
    return case_tree(cases).select("case_no", F.explode(F.flatten(F.transform(tops, with_inner))).alias("x")).select("case_no", "x.*")
