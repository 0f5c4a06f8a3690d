"""Nested JSON records as flat tables of unique objects and parent-child bridges.

Every object of a record gets a Merkle identity: the first 128 bits of a SHA-256 over its own canonical values and, in
order, the identities of its children, computed bottom-up. Members outside the layout are not read. An object that occurs a million times is stored once; the bridge
keeps every occurrence as (parent, child kind, ordinal, child). Parsing, hashing and shredding are JVM expressions
over Spark's variant type.

Defined results
    * payload null or not JSON: the record has no root and gives no rows.
    * a list part that is missing, null or empty: no elements. A part that stands bare counts as a list of one.
    * a null element: counted by its ordinal, without value. A value that is an object or list where text is
      expected: no value. Numbers and booleans come out as their JSON text.
    * repeated records: the objects are stored once, each distinct record_id keeps its own root.
    * extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litweave.runtime import materialise, skew_join


#: Bytes of an identity: among 10**12 objects two share one with a probability of about 10**-15.
IDENTITY_BYTES = 16


@dataclass(frozen=True)
class NodeSpec:
    """A kind of node: where its elements lie in the parent, and where value, attributes and children lie in it."""

    kind: str
    path: str
    value: str | None = None
    attrs: tuple[tuple[str, str], ...] = ()
    children: tuple[NodeSpec, ...] = ()
    bare_text: bool = False  # an element that is plain text is its own value


#: The layout of harvest payloads.
HARVEST = NodeSpec(
    "record",
    "$",
    children=(
        NodeSpec("date", "$.static_data.summary.pub_info.sortdate", bare_text=True),
        NodeSpec("title", "$.static_data.summary.titles.title", "$.content", (("type", "$.type"),)),
        NodeSpec(
            "abstract",
            "$.static_data.abstracts.abstract",
            None,
            (("lang", "$.lang"),),
            (NodeSpec("paragraph", "$.paragraphs.p", "$.content", bare_text=True),),
        ),
        NodeSpec(
            "author",
            "$.static_data.contributors.author",
            "$.auid",
            (("given", "$.given"), ("surname", "$.surname")),
            (NodeSpec("affiliation", "$.affiliations.affiliation", "$.afid", (("name", "$.name"), ("city", "$.address.city"), ("country", "$.address.country"))),),
        ),
        NodeSpec("identifier", "$.dynamic_data.identifiers.identifier", "$.value", (("type", "$.type"),)),
    ),
)


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with the value computed once, however often fn uses it."""
    return F.get(F.transform(F.array(value), lambda v: fn(v)), F.lit(0))


def _text(value: Column, path: str = "$") -> Column:
    """Text of a scalar at a path of a variant; null for null, objects and lists.

    Objects and lists come out as JSON text, so only text that starts like them needs a look at the type.
    """
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return _let(F.try_variant_get(value, path, "string"), lambda t: F.when(~t.rlike(r"^[{\[]") | ~kind.rlike("^(OBJECT|ARRAY)"), t))


def _elements(value: Column, path: str) -> Column:
    empty = F.array().cast("array<variant>")
    many = lambda p: F.coalesce(F.try_variant_get(p, "$", "array<variant>"), F.when(F.is_variant_null(p), empty).otherwise(F.array(p)))
    return _let(F.try_variant_get(value, path, "variant"), lambda p: F.when(p.isNull(), empty).otherwise(many(p)))


def _names(spec: NodeSpec) -> list[str]:
    """All attribute names of a layout, in the order of their first use."""
    return list(dict.fromkeys([n for n, _ in spec.attrs] + [n for c in spec.children for n in _names(c)]))


def _with(fn: Callable[..., Column], *rest) -> Callable[[Column], Column]:
    return lambda x: fn(x, *rest)


def _edge(spec: NodeSpec) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.struct(F.lit(spec.kind).alias("kind"), (i + 1).cast("long").alias("ordinal"), x["h"].alias("child"))


def _identity(read: Column, spec: NodeSpec) -> Column:
    """Merkle identity: kind, value and attributes in fixed order, then the children's identities in order."""
    parts = [F.lit(spec.kind).alias("k"), read["value"].alias("v"), read["attrs"].alias("a")]
    parts += [F.transform(read[f"kids_{c.kind}"], lambda x: x["h"]).alias(f"c{i}") for i, c in enumerate(spec.children)]
    return F.unhex(F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 2 * IDENTITY_BYTES))


def _node(element: Column, spec: NodeSpec, names: tuple[str, ...]) -> Column:
    """The element as (h, kind, value, attrs, edges, below), built from the leaves up; below holds all nodes under it."""
    value = F.lit(None).cast("string")
    if spec.value:
        value = _text(element, spec.value)
    if spec.bare_text:
        value = F.coalesce(_text(element), value)
    own = dict(spec.attrs)
    attrs = F.struct(*[(_text(element, own[n]) if n in own else F.lit(None).cast("string")).alias(n) for n in names])
    kids = [F.transform(_elements(element, c.path), _with(_node, c, names)).alias(f"kids_{c.kind}") for c in spec.children]

    def whole(read: Column) -> Column:
        edges = [F.transform(read[f"kids_{c.kind}"], _edge(c)) for c in spec.children]
        parts = [_identity(read, spec).alias("h"), F.lit(spec.kind).alias("kind"), read["value"].alias("value"), read["attrs"].alias("attrs")]
        parts.append((F.concat(*edges) if edges else F.array().cast("array<struct<kind:string,ordinal:bigint,child:binary>>")).alias("edges"))
        if spec.children:
            parts.append(F.concat(*[_nodes(read[f"kids_{c.kind}"], c) for c in spec.children]).alias("below"))
        return F.struct(*parts)

    return _let(F.struct(value.alias("value"), attrs.alias("attrs"), *kids), whole)


def _plain(node: Column) -> Column:
    return F.struct(*[node[c].alias(c) for c in ("h", "kind", "value", "attrs", "edges")])


def _nodes(kids: Column, spec: NodeSpec) -> Column:
    """The children and all nodes below them as one array."""
    if not spec.children:
        return kids
    return F.concat(F.transform(kids, _plain), F.flatten(F.transform(kids, lambda x: x["below"])))


@dataclass
class NestedStore:
    """roots(record_id, root), objects(h, kind, value, attrs, edges); the bridge is the objects' edges."""

    roots: DataFrame
    objects: DataFrame
    spec: NodeSpec

    def bridge(self) -> DataFrame:
        """(parent, kind, ordinal, child): one row for each place of a child in a distinct parent."""
        return self.objects.select(F.col("h").alias("parent"), F.inline("edges")).select("parent", "kind", "ordinal", "child")

    def table(self, kind: str) -> DataFrame:
        """The distinct objects of a kind with their attributes as columns."""

        def find(s: NodeSpec) -> NodeSpec | None:
            return s if s.kind == kind else next((f for c in s.children if (f := find(c))), None)

        return self.objects.where(F.col("kind") == kind).select(F.col("h").alias("object_id"), "value", *[F.col(f"attrs.{n}").alias(n) for n, _ in find(self.spec).attrs])

    def occurrences(self) -> DataFrame:
        """Every node of every record: (record_id, node_kind, parent_no, node_no, node_value).

        The values below an object are resolved once an object, from the leaves up through the bridge; the records then
        meet the finished objects, so a copied payload or a common object costs a join and no work of its own.
        """
        kinds, parents = _kinds(self.spec), _parents(self.spec)
        stored = lambda ks: self.objects.where(F.col("kind").isin(ks))
        nothing = F.array().cast(_BELOW)
        full = stored(kinds[-1]).select("h", "value", nothing.alias("below"))
        for level in reversed(kinds[1:-1]):
            inner = [k for k in level if k in parents]
            edges = stored(inner).select(F.col("h").alias("parent"), F.inline("edges")).withColumnRenamed("child", "h")
            rows = skew_join(edges, full, "h").select(F.col("parent").alias("h"), F.lit(None).cast("string").alias("value"), _rows_of_child().alias("below"))
            own = stored(inner).select("h", "value", nothing.alias("below"))
            grouped = own.unionByName(rows).groupBy("h").agg(F.max("value").alias("value"), F.flatten(F.collect_list("below")).alias("below"))
            full = stored([k for k in level if k not in parents]).select("h", "value", nothing.alias("below")).unionByName(grouped)
        top = skew_join(self.roots.withColumnRenamed("root", "h"), stored(kinds[0]).select("h", "edges"), "h")
        places = materialise(top.select("record_id", F.inline("edges")).withColumnRenamed("child", "h"), "nested-places")
        met = skew_join(places, full, "h").select("record_id", F.inline(_rows_of_child()))
        return met.select("record_id", F.col("kind").alias("node_kind"), F.coalesce("parent_no", F.lit(0)).cast("long").alias("parent_no"), "node_no", F.col("value").alias("node_value"))


#: What lies below an object: parent_no is null for its own children, whose parent is numbered where the object occurs.
_BELOW = "array<struct<kind:string,parent_no:bigint,node_no:bigint,value:string>>"


def _rows_of_child() -> Column:
    """A place (kind, ordinal) of an object (value, below) as the rows of the object and of all below it."""
    own = F.struct(F.col("kind"), F.lit(None).cast("long").alias("parent_no"), F.col("ordinal").alias("node_no"), F.col("value"))
    down = F.transform("below", lambda x: F.struct(x["kind"].alias("kind"), F.coalesce(x["parent_no"], F.col("ordinal")).alias("parent_no"), x["node_no"].alias("node_no"), x["value"].alias("value")))
    return F.concat(F.array(own), down)


def _parents(spec: NodeSpec) -> set[str]:
    """The kinds that have children."""
    return ({spec.kind} if spec.children else set()).union(*[_parents(c) for c in spec.children])


def _kinds(spec: NodeSpec) -> list[list[str]]:
    """The kinds at each depth."""
    below = [_kinds(c) for c in spec.children]
    return [[spec.kind], *[[k for b in below if d < len(b) for k in b[d]] for d in range(max(map(len, below), default=0))]]


def store_nested(df: DataFrame, key: str, payload: str, spec: NodeSpec = HARVEST) -> NestedStore:
    """Parse, hash bottom-up and store each identical object once. One shuffle, on the object, combined map-side."""
    parsed = df.select(F.col(key).alias("record_id"), F.try_parse_json(F.col(payload)).alias("v")).where(F.col("v").isNotNull() & ~F.is_variant_null("v"))
    tree = parsed.select("record_id", _node(F.col("v"), spec, tuple(_names(spec))).alias("t"))
    whole = F.concat(F.array(_plain(F.col("t"))), F.col("t.below")) if spec.children else F.array(_plain(F.col("t")))
    # a record's root travels with the objects, so that payloads are parsed once and nothing is written twice
    root = F.struct(F.col("t.h").alias("h"), F.lit(_ROOT).alias("kind"), *[F.lit(None).cast(_type(tree, c)).alias(c) for c in ("value", "attrs", "edges")], F.col("record_id"))
    nodes = F.transform(whole, lambda x: F.struct(*[x[c].alias(c) for c in ("h", "kind", "value", "attrs", "edges")], F.lit(None).cast(tree.schema["record_id"].dataType).alias("record_id")))
    # inline_outer, as inline adds a filter on the array that would build every tree again; the array is never empty
    rows = tree.select(F.concat(F.array(root), nodes).alias("nodes")).select(F.inline_outer("nodes"))
    # equal identities have equal content, so grouping by the whole row is grouping by identity, and stays a hash aggregate
    stored = materialise(rows.distinct(), "nested-objects")
    return NestedStore(stored.where(F.col("kind") == _ROOT).select("record_id", F.col("h").alias("root")), stored.where(F.col("kind") != _ROOT).drop("record_id"), spec)


#: Marks the row that gives a record its root.
_ROOT = "/"


def _type(tree: DataFrame, field: str):
    return tree.schema["t"].dataType[field].dataType


def flatten_values(df: DataFrame, key: str = "record_id", payload: str = "payload", spec: NodeSpec = HARVEST) -> DataFrame:
    """One row for each value that is present, with its ordinal and that of its parent."""
    return store_nested(df, key, payload, spec).occurrences().where(F.col("node_value").isNotNull())
