"""Dependency graphs: reachability and the feature-aware closure.

Both are one loop, ``derive``.  Roots are numbered and go in blocks of 64; what
is known of an atom is one row per block, a number whose bits are the roots it
holds for.  Packages that everything depends on, which make up most of a closure,
so take a row for 64 roots, and rows of single pairs are never made on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgrisk.session import Scratch, wide

# Dependency types and the edge kind each starts with.
KINDS = {"standard": "normal", "dev": "dev", "build": "build"}
_BITS = 64
# Passes over the rules of a loop that only saves time.
_PASSES = 8


class Facts(NamedTuple):
    """``state(id, block, bits)``, the place ``roots(root, block, bit)`` of each root, and ``atoms(atom, id)``."""

    state: DataFrame
    roots: DataFrame
    atoms: DataFrame


def _of_use(rules: DataFrame, scratch: Scratch) -> DataFrame:
    """``rules`` without those that bring an atom that is not asked for and brings nothing.

    What a pass drops may leave others without a use.  Passes end when nothing is
    dropped, or after some: a rule that stays takes time and changes no result.
    """
    for n in range(_PASSES):
        sources = rules.select(F.col("src").alias("dst")).distinct()
        kept = rules.filter("not asked").join(wide(sources), "dst", "left_semi").select(*rules.columns)
        before, rules = rules, scratch.save(rules.filter("asked").unionByName(kept), f"of-use-{n}")
        if rules.count() == before.count():
            break
    return rules


def _stand_ins(rules: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, to``: atoms that are not asked for and bring just ``to``, which stands in for them.

    Chains are followed in steps of twice the length.  Atoms whose stand-in has
    one itself, as on cycles, keep their place.
    """
    alone = F.col("n") & ~F.col("src_asked")
    only = (F.count(F.lit(1)) == 1) & (F.count("need") == 0)
    found = scratch.save(
        rules.groupBy("src", "src_asked").agg(only.alias("n"), F.min("dst").alias("to")).filter(alone).select(F.col("src").alias("id"), "to"), "stand-ins"
    )
    for n in range(_PASSES):
        beyond = found.select(F.col("id").alias("to"), F.col("to").alias("beyond"))
        longer = scratch.save(found.join(wide(beyond), "to", "left").select("id", F.coalesce("beyond", "to").alias("to"), "beyond"), f"stand-ins-{n}")
        found = longer.select("id", "to")
        if longer.filter("beyond is not null").isEmpty():
            break
    return found.join(wide(found.select(F.col("id").alias("to"))), "to", "left_anti").select("id", "to")


def _shortened(rules: DataFrame, atoms: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``rules`` between the atoms that are left, and the ``atoms`` of use with the ids that stand for them."""
    rules = _of_use(rules, scratch)
    other = scratch.save(_stand_ins(rules, scratch), "stands-in")
    kept = rules.join(wide(other.select(F.col("id").alias("src"))), "src", "left_anti").select("src", "need", "dst")
    kept = kept.join(wide(other), kept["dst"] == other["id"], "left").select("src", "need", F.coalesce("to", "dst").alias("dst"))
    kept = scratch.save(kept.filter("src <> dst or need is not null").distinct(), "short")
    sources = kept.select(F.col("src").alias("id")).distinct().withColumn("brings", F.lit(True))
    places = atoms.join(wide(other), "id", "left").join(wide(sources), "id", "left").filter("asked or brings or to is not null")
    return kept, scratch.save(places.select("atom", F.coalesce("to", "id").alias("id")), "places")


def _numbered(df: DataFrame, atoms: DataFrame, column: str, flag: str | None = None) -> DataFrame:
    """``df`` with the id of an atom in place of its text; rows of other atoms are left out.  ``flag``: whether it is asked for."""
    places = wide(atoms.select(F.col("atom").alias("_atom"), F.col("id").alias("_id"), *([F.col("asked").alias(flag)] if flag else [])))
    return df.join(places, df[column].eqNullSafe(F.col("_atom"))).withColumn(column, F.col("_id")).drop("_atom", "_id")


def derive(
    seeds: DataFrame,
    implications: DataFrame,
    both: DataFrame | None = None,
    label: str = "derive",
    asked: Callable[[Column], Column] | None = None,
) -> Facts:
    """Least fixpoint of the facts that start with ``seeds(root, atom)``.

    ``implications(src, dst)``: an atom brings another one.
    ``both(left, right, dst)``: two atoms of one root together bring another one.
    ``asked``: whether the caller looks at an atom; others may be missing where they bring nothing.

    Atoms are numbered first, since every round compares them; with ``asked``, rules
    are then shortened, which takes rounds and rows of the state.  A round passes on
    only the bits that the last one set.  What arrives for an atom and block is
    ORed with what is known of them under one aggregate, and the state is written
    once, old bits and new ones beside each other; the state before it is then
    dropped.  Cycles need no care: a bit is new once.  Rounds are as many as the
    longest way.
    """
    scratch = Scratch(seeds.sparkSession, label)
    rules = implications.select("src", F.lit(None).cast("string").alias("need"), "dst").filter("src <> dst").distinct()
    if both is not None:
        # Either half may arrive last, so each pair is kept under both.
        halves = both.select(F.col("left").alias("src"), F.col("right").alias("need"), "dst").unionByName(
            both.select(F.col("right").alias("src"), F.col("left").alias("need"), "dst")
        )
        rules = rules.unionByName(halves.distinct())
    rules = scratch.save(rules, "texts")
    texts = rules.select(F.explode(F.array_compact(F.array("src", "need", "dst"))).alias("atom")).unionByName(seeds.select("atom")).distinct()
    number = F.monotonically_increasing_id()
    is_asked = F.lit(True) if asked is None else asked(F.col("atom"))
    atoms = scratch.save(texts.select("atom", number.alias("id"), is_asked.alias("asked")), "atoms")
    rules = _numbered(_numbered(rules, atoms, "src", "src_asked"), atoms, "dst", "asked")
    if both is not None:
        rules = rules.filter("need is null").withColumn("need", F.lit(None).cast("bigint")).unionByName(_numbered(rules.filter("need is not null"), atoms, "need"))
    rules, places = scratch.save(rules.withColumn("need", F.col("need").cast("bigint")), "rules"), atoms
    if asked is not None:
        rules, places = _shortened(rules, atoms, scratch)
    single, pairs = scratch.save(rules.filter("need is null").select("src", "dst"), "single"), None
    if both is not None:
        pairs = scratch.save(rules.filter("need is not null").select("src", "need", "dst"), "pairs")
        if pairs.isEmpty():
            pairs = None
    # Neighbours in the order of their names share a block.
    ordered = seeds.select("root").distinct().repartitionByRange("root").sortWithinPartitions("root").withColumn("number", number)
    roots = scratch.save(
        ordered.select("root", F.expr(f"number div {_BITS}").alias("block"), F.expr(f"cast(number % {_BITS} as int)").alias("bit")), "roots"
    )
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    first = _numbered(seeds.select("root", "atom"), places, "atom").join(wide(roots), "root")
    first = first.select(F.col("atom").alias("id"), "block", F.call_function("shiftleft", one, F.col("bit")).alias("bits"))
    first = first.groupBy("id", "block").agg(F.bit_or("bits").alias("bits"))
    state = scratch.save(first.withColumn("fresh", F.col("bits")), "round-0")
    n = 0
    while not (delta := state.filter("fresh <> 0").select("id", "block", F.col("fresh").alias("bits"))).isEmpty():
        arrived = delta.join(wide(single), delta["id"] == single["src"]).select(F.col("dst").alias("id"), "block", "bits")
        if pairs is not None:
            half = delta.join(wide(pairs), delta["id"] == pairs["src"]).select(F.col("need").alias("id"), "block", F.col("bits").alias("half"), "dst")
            whole = half.join(wide(state), ["id", "block"]).select(F.col("dst").alias("id"), "block", F.col("half").bitwiseAND(F.col("bits")).alias("bits"))
            arrived = arrived.unionByName(whole.filter("bits <> 0"))
        known = state.select("id", "block", "bits", none.alias("came"))
        met = known.unionByName(arrived.select("id", "block", none.alias("bits"), F.col("bits").alias("came")))
        met = met.groupBy("id", "block").agg(F.bit_or("bits").alias("bits"), F.bit_or("came").alias("came"))
        merged = met.select(
            "id", "block", F.col("bits").bitwiseOR(F.col("came")).alias("bits"), F.col("came").bitwiseAND(F.bitwise_not("bits")).alias("fresh")
        )
        n += 1
        state = scratch.save(merged, f"round-{n}")
        scratch.drop(f"round-{n - 1}")
    return Facts(state.select("id", "block", "bits"), roots, atoms.select("atom", "id"))


def as_pairs(facts: Facts) -> DataFrame:
    """``root, atom`` rows, for results that are pairs by their nature.

    Rows meet the roots of their block before they become pairs, so pairs are
    not shuffled, and those of a root are made in one place.
    """
    held = facts.roots.groupBy("block").agg(F.collect_list(F.struct("bit", "root")).alias("held"))
    named = facts.state.join(wide(facts.atoms), "id").select("atom", "block", "bits")
    of = F.filter("held", lambda r: F.getbit("bits", r["bit"]) == 1)
    return named.join(wide(held), "block").select("atom", F.explode(of).alias("of")).select("of.root", "atom")


def counts_by_root(facts: Facts) -> DataFrame:
    """``root, count``: atoms of each root, as 64 sums a block; no pair is made."""
    sums = [F.sum(F.getbit("bits", F.lit(i)).cast("bigint")) for i in range(_BITS)]
    counted = facts.state.groupBy("block").agg(F.array(*sums).alias("sums"))
    return counted.select("block", F.posexplode("sums").alias("bit", "count")).join(wide(facts.roots), ["block", "bit"]).select("root", "count")


def _reach(edges: DataFrame, roots: DataFrame | None) -> Facts:
    links = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    first = links.withColumnRenamed("src", "root").withColumnRenamed("dst", "atom")
    if roots is not None:
        first = first.join(wide(roots.select(F.col("root").cast("string").alias("root")).distinct()), "root", "left_semi")
    return derive(first, links, label="reachable")


def reachable(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Distinct ``root, node`` pairs over ``edges(src, dst)``.

    A root is in its own set only if it lies on a cycle.
    """
    return as_pairs(_reach(edges, roots)).withColumnRenamed("atom", "node")


def transitive_dependency_counts(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """``package, transitive_dependencies``; 0 for a package without a node."""
    counted = counts_by_root(_reach(edges, packages.select(F.col("package").alias("root"))))
    return packages.join(wide(counted), packages["package"].cast("string") == counted["root"], "left").select(
        "package", F.coalesce("count", F.lit(0)).alias("transitive_dependencies")
    )


# --------------------------------------------------------------------------
# Declarations


def is_plain(activation: Column) -> Column:
    """A feature of the package itself, not a dependency or its feature."""
    return ~F.contains(activation, F.lit(":")) & ~F.contains(activation, F.lit("/"))


def expand_features(package_features: DataFrame, enabled: DataFrame) -> DataFrame:
    """All features ``enabled(pkg_id, feature)`` switches on inside each package."""
    step = package_features.filter(is_plain(F.col("activation")))
    facts = derive(
        enabled.select(F.col("pkg_id").cast("string").alias("root"), _feature(F.lit(_PLAIN), F.col("pkg_id"), F.col("feature")).alias("atom")),
        step.select(
            _feature(F.lit(_PLAIN), F.col("pkg_id"), F.col("feature")).alias("src"),
            _feature(F.lit(_PLAIN), F.col("pkg_id"), F.col("activation")).alias("dst"),
        ),
        label="features",
    )
    return as_pairs(facts).select(F.col("root").alias("pkg_id"), F.substring_index("atom", _SEP, -1).alias("feature"))


def _same_name(a: Column, b: Column, normalize: bool) -> Column:
    if not normalize:
        return a == b
    dash, bar = F.lit("-"), F.lit("_")
    return F.replace(a, dash, bar) == F.replace(b, dash, bar)


def edge_declarations(
    edges: DataFrame, package_deps: DataFrame, kinds: Sequence[str] = tuple(KINDS.values()), normalize_names: bool = False
) -> DataFrame:
    """Graph edges per kind with the declaration they belong to.

    A declaration matches by its rename or name; same kind first, then any
    kind, in declaration order.  Without one, ``declared`` is false.
    """
    by_kind = edges.select(
        "pkg_id", "dep_lib_name", "dep_pkg_id", F.explode(F.array_distinct("kinds")).alias("edge_kind")
    ).filter(F.col("edge_kind").isin(*kinds))
    declared = package_deps.select(
        F.col("pkg_id").alias("_pkg"),
        F.coalesce("rename", "name").alias("_label"),
        "kind",
        F.struct("ord", "name", "rename", "kind", "optional", "uses_default_features", "features").alias("_decl"),
    )
    match = (by_kind["pkg_id"] == declared["_pkg"]) & _same_name(
        by_kind["dep_lib_name"], declared["_label"], normalize_names
    )
    preference = F.struct(F.col("kind") != F.col("edge_kind"), F.col("_decl.ord"))
    return (
        by_kind.join(wide(declared), match, "left")
        .groupBy("pkg_id", "dep_lib_name", "dep_pkg_id", "edge_kind")
        .agg(F.min_by("_decl", F.when(F.col("_decl").isNotNull(), preference)).alias("decl"))
        .select(
            "pkg_id",
            "dep_lib_name",
            "dep_pkg_id",
            "edge_kind",
            F.col("decl").isNotNull().alias("declared"),
            F.coalesce("decl.rename", "decl.name").alias("label"),
            F.coalesce("decl.optional", F.lit(False)).alias("optional"),
            F.coalesce("decl.uses_default_features", F.lit(False)).alias("uses_default_features"),
            F.coalesce("decl.features", F.array()).alias("features"),
            F.col("decl.kind").alias("declared_kind"),
            F.col("decl.ord").alias("ord"),
        )
    )


_EDGE_KEY = ("pkg_id", "dep_lib_name", "dep_pkg_id", "edge_kind")


def activators(edges: DataFrame, package_features: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """``pkg_id, dep_lib_name, dep_pkg_id, edge_kind, feature`` that switch an optional edge on.

    Either the feature carries the dependency's name, or one of its activations
    is ``dep:x``, ``x/...`` or ``x``.  ``x?/...`` alone does not.  ``also``
    names further edge columns to carry along.
    """
    key = [*_EDGE_KEY, *also]
    optional = edges.filter("optional").select(*key)
    lib, act = F.col("dep_lib_name"), F.col("activation")
    target = F.when(act.startswith("dep:"), F.call_function("substring", act, F.lit(5))).when(
        F.contains(act, F.lit("/")), F.substring_index(act, "/", 1)
    ).otherwise(act)
    named = package_features.select("pkg_id", "feature", target.alias("dep_lib_name"), "activation").filter(
        act.startswith("dep:") | ~F.contains(act, F.lit(":")) | F.contains(act, F.lit("/"))
    )
    by_activation = optional.join(wide(named), ["pkg_id", "dep_lib_name"]).select(*key, "feature")
    by_name = optional.select(*key, lib.alias("feature"))
    return by_activation.unionByName(by_name).distinct()


def active_optional(edges: DataFrame, package_features: DataFrame, enabled: DataFrame) -> DataFrame:
    """Optional edges that some (already expanded) ``enabled(pkg_id, feature)`` switches on."""
    return (
        activators(edges, package_features)
        .join(wide(enabled), ["pkg_id", "feature"], "left_semi")
        .select("pkg_id", "dep_lib_name", "dep_pkg_id", "edge_kind")
        .distinct()
    )


def _passed_on(edges: DataFrame, package_features: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """``x/f`` and ``x?/f`` of the parent: feature -> feature of the dependency."""
    act = F.col("activation")
    label = F.regexp_replace(F.substring_index(act, "/", 1), r"\?$", "")
    passing = package_features.filter(F.contains(act, F.lit("/"))).select(
        "pkg_id",
        "feature",
        label.alias("label"),
        F.expr("substring(activation, instr(activation, '/') + 1)").alias("dep_feature"),
    )
    return edges.filter("declared").select(
        *_EDGE_KEY, *also, "label", "optional"
    ).join(wide(passing), ["pkg_id", "label"])


def dependency_features(edges: DataFrame, package_features: DataFrame, enabled: DataFrame) -> DataFrame:
    """``pkg_id, dep_lib_name, dep_pkg_id, edge_kind, feature`` handed to each dependency."""
    key = list(_EDGE_KEY)
    known = edges.filter("declared")
    default = known.filter("uses_default_features").select(*key, F.lit("default").alias("feature"))
    stated = known.select(*key, F.explode("features").alias("feature"))
    passed = (
        _passed_on(edges, package_features)
        .join(wide(enabled), ["pkg_id", "feature"], "left_semi")
        .select(*key, F.col("dep_feature").alias("feature"))
    )
    return default.unionByName(stated).unionByName(passed).distinct()


# --------------------------------------------------------------------------
# The closure as implications

# An atom is (space, kind, package, ...).  Kinds: V the package is needed, F a
# feature is on, E an edge is taken.  The one space "" holds packages reached
# over any number of hops.  What a root's own edges bring, which depends on the
# dependency type, is looked up before the rounds.
_SEP = "\x1f"
_PLAIN = ""


def _atom(space: Column, kind: str, *parts: Column) -> Column:
    return F.concat_ws(_SEP, space, F.lit(kind), *[p.cast("string") for p in parts])


def _visited(space: Column, pkg: Column) -> Column:
    return _atom(space, "V", pkg)


def _feature(space: Column, pkg: Column, feature: Column) -> Column:
    return _atom(space, "F", pkg, feature)


def _edge(space: Column) -> Column:
    return _atom(space, "E", F.col("pkg_id"), F.col("dep_lib_name"), F.col("dep_pkg_id"))


def _is_package(atom: Column) -> Column:
    return F.startswith(atom, F.lit(f"{_PLAIN}{_SEP}V"))


def _on() -> Column:
    return _feature(F.lit(_PLAIN), F.col("pkg_id"), F.col("feature"))


def _handed() -> Column:
    return _feature(F.lit(_PLAIN), F.col("dep_pkg_id"), F.col("dep_feature"))


def _brought() -> Column:
    """What a taken edge brings: the package, its default feature, stated features."""
    plain, dep = F.lit(_PLAIN), F.col("dep_pkg_id")
    default = F.when(F.col("uses_default_features"), _feature(plain, dep, F.lit("default")))
    stated = F.transform("features", lambda f: _feature(plain, dep, f))
    return F.array_compact(F.concat(F.array(_visited(plain, dep), default), stated))


def _switched(features: DataFrame) -> DataFrame:
    """``src, dst``: features that switch on others of their package."""
    activation = _feature(F.lit(_PLAIN), F.col("pkg_id"), F.col("activation"))
    return features.filter(is_plain(F.col("activation"))).select(_on().alias("src"), activation.alias("dst"))


_BRINGS = ("uses_default_features", "features")


def _rules(edges: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Single and paired implications."""
    plain = F.lit(_PLAIN)
    passed = _passed_on(edges, features)
    taken = _edge(plain)
    weak = passed.filter("optional")
    waits = weak.select(*_EDGE_KEY).distinct()
    switches = activators(edges, features, _BRINGS)
    rules = [
        _switched(features),
        edges.filter("not optional").select(_visited(plain, F.col("pkg_id")).alias("src"), F.explode(_brought()).alias("dst")),
        switches.select(_on().alias("src"), F.explode(_brought()).alias("dst")),
        passed.filter("not optional").select(_on().alias("src"), _handed().alias("dst")),
        # That an edge is taken matters by itself only where something waits for it.
        switches.join(wide(waits), list(_EDGE_KEY), "left_semi").select(_on().alias("src"), taken.alias("dst")),
    ]
    both = weak.select(_on().alias("left"), taken.alias("right"), _handed().alias("dst"))
    return reduce(DataFrame.unionByName, rules), both


def _first_hop(ids: DataFrame, edges: DataFrame, features: DataFrame, enabled: DataFrame, types: Sequence[str], scratch: Scratch) -> DataFrame:
    """``root, atom``: what the edges of each root and type bring; ``root`` is type and package.

    A root's features come from its own ones alone, so they need no type, and its
    edges are looked at once.
    """
    pkg = F.col("pkg_id").cast("string")
    own = features.join(wide(ids), "pkg_id", "left_semi")
    start = ids.join(wide(enabled), "pkg_id").select(pkg.alias("root"), _on().alias("atom"))
    facts = derive(start, _switched(own), label="closure-features")
    on = scratch.save(facts.atoms.join(wide(facts.state.select("id").distinct()), "id", "left_semi").select("atom"), "on")

    def is_on(df: DataFrame) -> DataFrame:
        return df.withColumn("atom", _on()).join(wide(on), "atom", "left_semi")

    type_of = F.coalesce(*[F.when(F.col("edge_kind") == KINDS[t], t) for t in types])
    mine = scratch.save(edges.filter(type_of.isNotNull()).join(wide(ids), "pkg_id", "left_semi"), "own-edges")
    key = F.concat_ws(_SEP, type_of, pkg).alias("root")
    switches = scratch.save(is_on(activators(mine, own, _BRINGS)).select(*_EDGE_KEY, *_BRINGS).distinct(), "switches")
    passed = is_on(_passed_on(mine, own))
    weak = passed.filter("optional").join(wide(switches.select(*_EDGE_KEY).distinct()), list(_EDGE_KEY), "left_semi")
    seeds = [
        mine.filter("not optional").select(key, F.explode(_brought()).alias("atom")),
        switches.select(key, F.explode(_brought()).alias("atom")),
        passed.filter("not optional").select(key, _handed().alias("atom")),
        weak.select(key, _handed().alias("atom")),
    ]
    return reduce(DataFrame.unionByName, seeds)


def select_roots(packages: DataFrame, names: Sequence[str] = (), workspace: bool = False) -> DataFrame:
    """Named members, all members, or the root package if there is one.

    A name that is no workspace member is an error.
    """
    members = packages.filter("is_member")
    if names:
        known = {r.name for r in members.filter(F.col("name").isin(*names)).select("name").distinct().collect()}
        for name in names:
            if name not in known:
                raise ValueError(f"package '{name}' not found in workspace")
        return members.filter(F.col("name").isin(*names)).select("pkg_id")
    if workspace:
        return members.select("pkg_id")
    root = packages.filter("is_root")
    return (members if root.isEmpty() else root).select("pkg_id")


def closure_facts(
    roots: DataFrame,
    package_features: DataFrame,
    package_deps: DataFrame,
    resolve_edges: DataFrame,
    resolve_features: DataFrame,
    types: Sequence[str] = (),
    normalize_names: bool = False,
) -> DataFrame:
    """``root, type, pkg_id``: packages in the closure of each root and dependency type.

    The first hop follows edges of the type's kind, later hops normal edges.
    Optional edges need an active feature; features travel along the edges.
    """
    wanted = [t for t in KINDS if not types or t in types]
    scratch = Scratch(roots.sparkSession, "closure-input")
    edges = scratch.save(edge_declarations(resolve_edges, package_deps, normalize_names=normalize_names), "edges")
    features = scratch.save(package_features.select("pkg_id", "feature", "activation").distinct(), "features")
    ids = roots.select("pkg_id").distinct()
    seeds = scratch.save(_first_hop(ids, edges, features, resolve_features, wanted, scratch), "seeds")
    # Later hops follow normal edges.
    rules, both = _rules(edges.filter(F.col("edge_kind") == KINDS["standard"]), features)
    facts = derive(seeds, rules, both, label="closure", asked=_is_package)
    # Names of roots are read once a root, not once a pair.
    named = F.struct(F.substring_index("root", _SEP, -1).alias("root"), F.substring_index("root", _SEP, 1).alias("type"))
    packages = facts.atoms.filter(_is_package(F.col("atom"))).withColumn("atom", F.get(F.split("atom", _SEP), F.lit(2)))
    return as_pairs(Facts(facts.state, facts.roots.withColumn("root", named), packages)).select("root.root", "root.type", F.col("atom").alias("pkg_id"))


def closure_requests(closure: DataFrame, packages: DataFrame) -> DataFrame:
    """Distinct ``name, version`` requests over all roots and types."""
    ids = closure.select("pkg_id").distinct()
    return packages.withColumn("pkg_id", F.col("pkg_id").cast("string")).join(wide(ids), "pkg_id", "left_semi").select(
        "name", "version"
    ).distinct()
