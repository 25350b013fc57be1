"""Module contracts: the obligations that a contract expands to, and exports, declarations, imports and
packages compared with what a code base shows, in both directions.

Every comparison gives rows (module, id, status, code). Forward ids are those of obligations; inverse
ones begin with "observed.". Contracts are tables with a row for each declared thing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.identity import ancestors
from factloom.functions.text import encode_id
from factloom.operators.conformance import is_test

#: A declaration's parts: (part, array column, what the id says of a member, kind of the obligation).
PARTS = [
    ("type_parameters", "type-parameter.", "position", "type-parameter"),
    ("call_type_parameters", "call-signature.type-parameter.", "position", "type-parameter"),
    ("facet_type_parameters", "facet.type.type-parameter.", "position", "type-parameter"),
    ("fields", "field.", "name", "member"),
    ("properties", "property.", "name", "member"),
    ("callables", "callable.", "name", "member"),
    ("statics", "static.", "name", "member"),
    ("overloads", "overload.", "position", "overload"),
    ("parameters", "parameter.", "both", "parameter"),
    ("errors", "error.", "encoded", "error-code"),
    ("extends", "extends.", "encoded", "heritage"),
    ("implements", "implements.", "encoded", "heritage"),
]
#: Columns of a declarations table: identity, the parts' names, and single things that it may have.
DECLARATIONS = "module string, kind string, name string, key string, " + ", ".join(f"{p} array<string>" for p, *_ in PARTS) + ", value_type boolean, returns boolean, mode string, facets boolean, facet_value_type boolean, facet_type_value boolean"


def prefix(kind: Column, key: Column) -> Column:
    return F.concat(F.lit("module."), kind, F.lit("."), encode_id(key))


def obligations(modules: DataFrame, exports: DataFrame, declarations: DataFrame, imports: DataFrame, packages: DataFrame) -> DataFrame:
    """(module, id, kind) of contracts: modules (module), exports (module, path, kind), declarations
    (DECLARATIONS), imports (module, kind, key), packages (module, package).

    A declaration's row is exploded once to all that it has; nothing is joined.
    """
    one = lambda id_, kind: F.struct(id_.alias("id"), F.lit(kind).alias("kind"))
    own = prefix(F.col("kind"), F.col("key"))
    some = lambda part: F.coalesce(F.col(part), F.array().cast("array<string>"))

    def part(column: str, says: str, by: str, kind: str) -> Column:
        told = {
            "position": lambda x, i: i.cast("string"), "name": lambda x, i: x, "encoded": lambda x, i: encode_id(x), "both": lambda x, i: F.concat_ws(".", i.cast("string"), x),
        }[by]
        return F.transform(some(column), lambda x, i: one(F.concat(own, F.lit(f".{says}"), told(x, i)), kind))

    called = F.col("kind").isin("interface", "class") & (F.coalesce("returns", F.lit(False)) | (F.size(some("overloads")) > 0))
    single = [
        (F.lit(True), "", "declaration"), (F.col("value_type"), ".type", "value-type"), (called, ".call-signature", "member"),
        (F.col("returns"), ".return", "return"), (F.col("mode").isNotNull(), ".mode", "mode"), (F.col("facets"), ".facet.type", "type-facet"), (F.col("facets"), ".facet.value", "value-facet"),
        (F.col("facets") & F.col("facet_type_value"), ".facet.type.value", "value-type"), (F.col("facets") & F.col("facet_value_type"), ".facet.value.type", "value-type"),
    ]
    alone = F.array_compact(F.array(*[F.when(F.coalesce(has, F.lit(False)), one(F.concat(own, F.lit(tail)), kind)) for has, tail, kind in single]))
    lists = [F.when(F.col("facets"), part(*p)).otherwise(F.array().cast("array<struct<id:string,kind:string>>")) if p[0] == "facet_type_parameters" else part(*p) for p in PARTS]
    parts = declarations.select("module", F.explode(F.concat(alone, *lists)).alias("o")).select("module", "o.id", "o.kind")
    return (
        modules.select("module", F.concat(F.lit("module."), "module").alias("id"), F.lit("module").alias("kind"))
        .unionByName(exports.select("module", F.concat(F.lit("module.export."), "path", F.lit("."), "kind").alias("id"), F.lit("export").alias("kind")))
        .unionByName(parts)
        .unionByName(imports.select("module", F.concat(F.lit("module.import."), "kind", F.lit("."), encode_id(F.col("key"))).alias("id"), F.lit("import").alias("kind")))
        .unionByName(packages.select("module", F.concat(F.lit("module.package."), "package").alias("id"), F.lit("package").alias("kind")))
    )


def kinds_fit(expected: Column, observed: Column, pair: Column, typed: Column, external: Column) -> Column:
    """Whether a declared kind allows an observed one. `pair`: a type and a value of one name are declared;
    `typed`: the declared value has a type; `external`: that type is another package's."""
    value = expected == "value"
    return (
        F.when(pair, value & (observed == "factory"))
        .when(value & external & observed.isin("value", "callable", "interface", "class"), True)
        .when(observed == "factory", False)
        .otherwise((expected == observed) | (value & (observed == "callable") & typed) | (value & (observed == "interface")))
    )


def exports(expected: DataFrame, observed: DataFrame, declarations: DataFrame) -> DataFrame:
    """(module, path, id, status, code) of exports, from both sides.

    expected: (module, path, kind, name, type_only, source, opaque, facets, factory, typed, external):
    source is the module that an export comes from, null for the own one; an opaque one is compared by
    identity alone, and what is exported below it isn't looked at. observed: (module, path, kind,
    declaration, type_only, source). declarations: (declaration, name, kind), those that could be read.
    """
    read = declarations.select(F.col("declaration").alias("d_id"), F.col("name").alias("d_name"), F.col("kind").alias("d_kind"))
    seen = observed.select(F.col("module").alias("o_module"), F.col("path").alias("o_path"), F.col("kind").alias("o_kind"), F.col("declaration").alias("o_decl"), F.col("type_only").alias("o_type"), F.col("source").alias("o_source"))
    seen = seen.join(read, F.col("o_decl") == F.col("d_id"), "left")
    want = expected.select(*[F.col(c).alias(f"e_{c}") for c in ("module", "path", "kind", "name", "type_only", "source", "opaque", "facets", "factory", "typed", "external")])
    met = want.join(seen, (F.col("e_module") == F.col("o_module")) & (F.col("e_path") == F.col("o_path")), "full_outer")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    factory, both = F.col("d_kind") == "factory", flag("e_facets") | flag("e_factory")
    projected = factory & flag("o_type") & ~flag("e_facets")
    foreign, modes = F.col("e_source").isNotNull(), flag("e_type_only") != flag("o_type")
    fit = (projected & (F.col("e_kind") == "value")) | kinds_fit(F.col("e_kind"), F.col("d_kind"), both, flag("e_typed"), flag("e_external"))
    opaque = foreign & flag("e_opaque")
    ladder = [
        (F.col("e_path").isNull(), "MODULE_EXPORT_UNDECLARED"),
        (F.col("o_path").isNull(), "MODULE_EXPORT_MISSING"),
        (F.col("d_id").isNull(), "MODULE_EXPORT_UNRESOLVED"),
        (foreign & (~F.col("o_source").eqNullSafe(F.col("e_source")) | (F.col("d_name") != F.col("e_name"))), "MODULE_DECLARATION_IDENTITY_MISMATCH"),
        (opaque & modes, "MODULE_EXPORT_TYPE_MODE_MISMATCH"),
        (opaque, "MATCHED"),
        (factory & ~both & ~projected, "MODULE_FACTORY_FACETS_UNSPECIFIED"),
        (both & ~factory, "MODULE_FACTORY_FACETS_MISSING"),
        (modes, "MODULE_EXPORT_TYPE_MODE_MISMATCH"),
        (~fit, "MODULE_EXPORT_KIND_MISMATCH"),
        (~flag("e_type_only") & flag("o_type") & ((F.col("o_kind") == "class") | ((F.col("o_kind") == "factory") & flag("e_facets"))), "MODULE_RUNTIME_EXPORT_MISSING"),
    ]
    code = reduce(lambda c, rung: c.when(*rung), ladder[1:], F.when(*ladder[0])).otherwise("MATCHED")
    told = met.select(F.coalesce("e_module", "o_module").alias("module"), F.coalesce("e_path", "o_path").alias("path"), "e_kind", "o_kind", opaque.alias("opaque"), code.alias("code"))
    # what is exported below an opaque export that matched is not this module's to declare
    roof = told.where("opaque AND code = 'MATCHED'").select(F.col("module").alias("r_module"), F.col("path").alias("r_path"))
    up = told.where("code = 'MODULE_EXPORT_UNDECLARED'").select("module", "path", F.explode(ancestors(F.replace("path", F.lit("."), F.lit("/")), False)).alias("up"))
    below = up.join(roof, (F.col("module") == F.col("r_module")) & (F.replace("up", F.lit("/"), F.lit(".")) == F.col("r_path")), "left_semi").select(F.col("module").alias("b_module"), F.col("path").alias("b_path")).distinct()
    told = told.join(below, (F.col("module") == F.col("b_module")) & (F.col("path") == F.col("b_path")), "left_anti")
    forward = F.concat(F.lit("module.export."), "path", F.lit("."), "e_kind")
    inverse = F.concat(F.lit("observed.export."), encode_id(F.col("path")), F.lit("."), "o_kind")
    status = F.when(F.col("code") == "MATCHED", "pass").when(F.col("code").isin("MODULE_EXPORT_UNRESOLVED", "MODULE_FACTORY_FACETS_UNSPECIFIED"), "error").otherwise("fail")
    sides = F.array_compact(F.array(F.when(F.col("e_kind").isNotNull(), forward), F.when(F.col("code").isin("MATCHED", "MODULE_EXPORT_UNDECLARED"), inverse)))
    return told.select("module", "path", F.explode(sides).alias("id"), status.alias("status"), F.when(F.col("code") != "MATCHED", F.col("code")).alias("code"))


def declarations(expected: DataFrame, observed: DataFrame, bound: DataFrame) -> DataFrame:
    """(module, id, status, code): declared things (module, kind, key) that no export led to, observed ones
    (module, declaration) that none was bound to, and those of either side that were. bound: (module, key, declaration)."""
    by_key = bound.select(F.col("module").alias("__m"), F.col("key").alias("__k")).distinct()
    forward = expected.join(by_key, (F.col("module") == F.col("__m")) & (F.col("key") == F.col("__k")), "left")
    forward = forward.select("module", prefix(F.col("kind"), F.col("key")).alias("id"), F.col("__k").isNotNull().alias("ok"), F.lit("MODULE_DECLARATION_MISSING").alias("code"))
    by_id = bound.select(F.col("module").alias("__m"), F.col("declaration").alias("__d")).distinct()
    inverse = observed.join(by_id, (F.col("module") == F.col("__m")) & (F.col("declaration") == F.col("__d")), "left")
    inverse = inverse.select("module", F.concat(F.lit("observed.declaration."), encode_id(F.col("declaration"))).alias("id"), F.col("__d").isNotNull().alias("ok"), F.lit("MODULE_PUBLIC_TYPE_UNDECLARED").alias("code"))
    both = forward.unionByName(inverse)
    return both.select("module", "id", F.when(F.col("ok"), "pass").otherwise("fail").alias("status"), F.when(~F.col("ok"), F.col("code")).alias("code"))


def error_codes(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(module, id, status, code): whether error codes (module, kind, key, error) are declared in code (module, error)."""
    seen = observed.select(F.col("module").alias("__m"), F.col("error").alias("__e")).distinct()
    met = expected.join(seen, (F.col("module") == F.col("__m")) & (F.col("error") == F.col("__e")), "left")
    ok = F.col("__e").isNotNull()
    return met.select("module", F.concat(prefix(F.col("kind"), F.col("key")), F.lit(".error."), encode_id(F.col("error"))).alias("id"), F.when(ok, "pass").otherwise("fail").alias("status"), F.when(~ok, "ERROR_CODE_MISSING").alias("code"))


def imports(expected: DataFrame, used: DataFrame, owners: DataFrame) -> DataFrame:
    """(module, id, status, code): imports (module, kind, key) that the public surface doesn't use, and used
    ones (module, key) of other modules that aren't imported. owners: (key, owner)."""
    use = used.select(F.col("module").alias("__m"), F.col("key").alias("__k")).distinct()
    forward = expected.join(use, (F.col("module") == F.col("__m")) & (F.col("key") == F.col("__k")), "left")
    ok = F.col("__k").isNotNull()
    forward = forward.select("module", F.concat(F.lit("module.import."), "kind", F.lit("."), encode_id(F.col("key"))).alias("id"), F.when(ok, "pass").otherwise("fail").alias("status"), F.when(~ok, "MODULE_CONTRACT_IMPORT_STALE").alias("code"))
    foreign = used.distinct().join(owners.select(F.col("key").alias("__k"), "owner"), F.col("key") == F.col("__k")).where("owner != module").select("module", "key")
    lost = foreign.join(expected.select("module", "key"), ["module", "key"], "left_anti")
    return forward.unionByName(lost.select("module", F.concat(F.lit("observed.import."), encode_id(F.col("key"))).alias("id"), F.lit("fail").alias("status"), F.lit("MODULE_CONTRACT_IMPORT_UNDECLARED").alias("code")))


def dependencies(allowed: DataFrame, patterns: DataFrame, installed: DataFrame, edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, id, status, code) of packages and dependency edges.

    allowed: (module, package, observed): packages that may be used, and whether they have to be;
    patterns: (module, pattern), with a final *; installed: (module, package, workspace, development);
    edges: (edge, module, target, file, deep, provided), a row for each occurrence: target is
    package:<name>, platform:<name> or a module; deep ones bypass an entrypoint; provided ones come with a
    public type whose own module declares the package. modules: (module), those that are known.

    An edge is judged by its worst occurrence: an occurrence that isn't permitted, deep ones first.
    """
    name = F.when(F.col("target").startswith("package:"), F.substring("target", 9, 1 << 30))
    e = edges.withColumn("package", name)
    key = lambda df, *c: df.select(F.col("module").alias("__m"), F.col("package").alias("__p"), *c)
    on = (F.col("module") == F.col("__m")) & (F.col("package") == F.col("__p"))
    used = e.where("package IS NOT NULL").select("module", "package").distinct()
    forward = allowed.select("module", "package", F.col("observed").alias("needs"))
    forward = forward.join(key(installed).distinct().withColumn("there", F.lit(True)), on, "left").drop("__m", "__p").join(key(used).withColumn("seen", F.lit(True)), on, "left")
    lost = F.when(F.col("there").isNull(), "MODULE_PACKAGE_NOT_DECLARED").when(F.coalesce("needs", F.lit(True)) & F.col("seen").isNull(), "MODULE_PACKAGE_STALE")
    forward = forward.select("module", F.concat(F.lit("module.package."), "package").alias("id"), F.when(lost.isNull(), "pass").otherwise("fail").alias("status"), lost.alias("code"))

    # patterns hold what begins with them: a package's beginnings are joined by equality
    heads = used.withColumn("head", F.explode(F.transform(F.sequence(F.lit(0), F.length("package")), lambda n: F.substr("package", F.lit(1), n))))
    rule = patterns.select(F.col("module").alias("__m"), F.expr("substr(pattern, 1, length(pattern) - 1)").alias("__h"))
    fit = heads.join(rule, (F.col("module") == F.col("__m")) & (F.col("head") == F.col("__h")), "left_semi").select("module", "package")
    fine = key(allowed.select("module", "package").unionByName(fit).distinct()).withColumn("allowed", F.lit(True))
    own = key(installed.groupBy("module", "package").agg(F.max("workspace").alias("ws"), F.max("development").alias("dev")), "ws", "dev")
    met = e.join(fine, on, "left").drop("__m", "__p").join(own, on, "left").drop("__m", "__p")
    met = met.join(modules.select(F.col("module").alias("__known")).distinct(), F.col("target") == F.col("__known"), "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    grounded = yes("allowed") | yes("ws") | (yes("dev") & is_test(F.col("file"))) | yes("provided")
    free = F.col("target").startswith("platform:") | F.col("__known").isNotNull() | (F.col("package").isNotNull() & grounded)
    code = F.when(yes("deep"), "MODULE_DEEP_IMPORT").when(free, None).when(F.col("package").isNotNull(), "MODULE_PACKAGE_UNDECLARED").otherwise("MODULE_DEPENDENCY_UNOWNED")
    judged = met.select("module", "edge", code.alias("code")).groupBy("module", "edge").agg(F.min("code").alias("code"))  # deep sorts first
    inverse = judged.select("module", F.concat(F.lit("observed.dependency."), encode_id(F.col("edge"))).alias("id"), F.when(F.col("code").isNull(), "pass").otherwise("fail").alias("status"), "code")
    return forward.unionByName(inverse)
