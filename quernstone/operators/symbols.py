"""Names resolved to symbols, imports resolved to files, and the graphs they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Extensions tried for a module without one, in this order.
MODULE_EXTENSIONS = ["ts", "tsx", "js", "jsx", "mjs", "cjs"]


def leaf(name: Column) -> Column:
    """The last part of a qualified name."""
    return F.regexp_extract(name, r"([^.:#]+)$", 1)


def resolve_names(refs: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """(ref_id, status, symbol_id, candidates): symbols of the name of each reference in its repo.

    refs: ref_id, repo, file, name; symbols: symbol_id, repo, file, name; imports, if given: repo, src, dst (files that a file imports).
    Symbols of the reference's own file come first, then those of files it imports, then those of its repo; at each of these the whole name before
    its last part. One best symbol resolves a reference, several are ambiguous (symbol_id null), none leaves it unresolved. Candidates are counted, never
    gathered, as a name may be everywhere. With keep, these columns of refs and `level` (file, import or repo) come along.
    """
    named = symbols.select("symbol_id", "repo", "file", "name").withColumn("leaf", leaf(F.col("name")))
    forms = named.select("symbol_id", "repo", "file", F.col("name").alias("key"), F.lit(0).alias("form")).unionByName(
        named.filter("leaf != name and leaf != ''").select("symbol_id", "repo", "file", F.col("leaf").alias("key"), F.lit(1).alias("form")))
    whole_only = lambda v: F.when(F.col("form") == 0, v)
    # symbols whose whole name fits go before those of which the last part does
    found = lambda df, keys: df.groupBy(*keys, "key").agg(
        F.min(whole_only(F.col("symbol_id"))).alias("w"), F.min("symbol_id").alias("a"), F.count(whole_only(F.lit(1))).alias("wn"), F.count(F.lit(1)).alias("an")
    ).select(*keys, "key", F.when(F.col("wn") > 0, F.col("w")).otherwise(F.col("a")).alias("s"), F.when(F.col("wn") > 0, F.col("wn")).otherwise(F.col("an")).alias("n"))
    levels = [("file", found(forms, ["repo", "file"]), ["repo", "file"])]
    if imports is not None:
        reached = imports.select("repo", F.col("src").alias("file"), "dst").filter("dst is not null").distinct().join(forms.withColumnRenamed("file", "dst"), ["repo", "dst"])
        levels.append(("import", found(reached.select("symbol_id", "repo", "file", "key", "form"), ["repo", "file"]), ["repo", "file"]))
    levels.append(("repo", found(forms, ["repo"]), ["repo"]))
    asked = refs.withColumn("__leaf", leaf(F.col("name")))
    qualified = F.coalesce((F.col("name") != F.col("__leaf")) & (F.col("__leaf") != ""), F.lit(False))

    def resolved(rows: DataFrame, names: list[str]) -> DataFrame:
        """Rows with what each level finds for each of the names, level by level."""
        order = []
        for level, side, keys in levels:
            for of in names:
                at = f"__{level}{of}"
                by = side.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("key").alias("__key"), F.struct("s", "n", F.lit(level).alias("level")).alias(at))
                on = F.col("__key") == F.col(of)
                for i, k in enumerate(keys):
                    on = on & (F.col(k) == F.col(f"__k{i}"))
                rows = rows.join(by, on, "left").drop("__key", *[f"__k{i}" for i in range(len(keys))])
                order.append(at)
        return rows.withColumn("__pick", F.coalesce(*order)).drop(*order)

    # names without parts need no look at their last one
    out = resolved(asked.filter(~qualified), ["name"]).unionByName(resolved(asked.filter(qualified), ["name", "__leaf"]))
    pick = F.col("__pick")
    n = F.coalesce(pick["n"], F.lit(0))
    extra = [*(keep or []), *([pick["level"].alias("level")] if keep else [])]
    return out.select("ref_id", F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous").alias("status"), F.when(n == 1, pick["s"]).alias("symbol_id"), n.alias("candidates"), *extra)


def normal_join(folder: Column, spec: Column) -> Column:
    """folder/spec with `.` and `..` parts worked off; null where it climbs out of the root."""
    parts = F.filter(F.split(F.concat_ws("/", folder, spec), "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("a"), F.lit(True).alias("ok"))
    done = F.aggregate(parts, start, lambda s, p: F.when(
        p == "..", F.struct(F.slice(s["a"], 1, F.greatest(F.size(s["a"]) - 1, F.lit(0))).alias("a"), (s["ok"] & (F.size(s["a"]) > 0)).alias("ok"))
    ).otherwise(F.struct(F.concat(s["a"], F.array(p)).alias("a"), s["ok"].alias("ok"))))
    return F.when(done["ok"], F.array_join(done["a"], "/"))


# Suffixes of files by how their imports name other files.
IMPORTERS = {"js": ("js", "mjs", "cjs", "jsx", "ts", "tsx"), "py": ("py", "pyi"), "rs": ("rs",), "go": ("go",), "c": ("c", "h", "cc", "cpp", "hpp")}
_RUST_LOCAL = r"^(crate|self|super)::"


def import_candidates(src: Column, spec: Column) -> Column:
    """struct(language, relative, escaped, folder, candidates): where an import of a file may lead, by the rules of its language, the most likely first.

    candidates: struct(path, stage). JavaScript and TypeScript: the path itself, with an extension, as an index file. Python: a module or package, from as many folders
    up as there are dots, else from the root. Rust: from the crate's src, the own or the parent's folder, a module or one that holds the last name. Go:
    folders, by ever shorter ends of the import path. C: beside the file, then below include and the root.
    """
    suffix = F.lower(F.regexp_extract(src, r"\.([A-Za-z0-9]+)$", 1))
    language = F.lit("other")
    for name, ends in IMPORTERS.items():
        language = F.when(suffix.isin(*ends), name).otherwise(language)
    folder = F.regexp_extract(src, r"^(.*)/[^/]*$", 1)
    one = lambda path, stage: F.struct(path.alias("path"), F.lit(stage).alias("stage"))
    js_relative = spec.rlike(r"^\.{1,2}/")
    js = normal_join(folder, spec)
    indexes = [one(F.concat(js, F.lit("/index." + e)), "index") for e in MODULE_EXTENSIONS]
    extended = [one(F.concat(js, F.lit("." + e)), "extension") for e in MODULE_EXTENSIONS]
    of_js = F.when(spec.rlike(r"\.[A-Za-z0-9]+$"), F.array(one(js, "exact"))).when(spec.endswith("/"), F.array(*indexes)).otherwise(F.array(one(js, "exact"), *extended, *indexes))
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))
    py = F.when(dots == 0, rest).otherwise(normal_join(folder, F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), rest)))
    package = one(F.when(py == "", F.lit("__init__.py")).otherwise(F.concat(py, F.lit("/__init__.py"))), "index")
    of_py = F.when(rest == "", F.array(package)).otherwise(F.array(one(F.concat(py, F.lit(".py")), "extension"), package))
    start = F.regexp_extract(spec, _RUST_LOCAL, 1)
    tail = F.replace(F.regexp_replace(spec, _RUST_LOCAL, ""), F.lit("::"), F.lit("/"))
    rs = F.when(start == "crate", F.concat(F.lit("src/"), tail)).when(start == "self", normal_join(folder, tail)).otherwise(normal_join(folder, F.concat(F.lit("../"), tail)))
    holder = F.regexp_extract(rs, r"^(.*)/[^/]*$", 1)
    of_rs = F.array(one(F.concat(rs, F.lit(".rs")), "extension"), one(F.concat(rs, F.lit("/mod.rs")), "index"), one(F.concat(holder, F.lit(".rs")), "parent"), one(F.concat(holder, F.lit("/mod.rs")), "parent"))
    parts = F.split(spec, "/")
    of_go = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("path"), F.lit("folder").alias("stage")))
    of_c = F.array(one(normal_join(folder, spec), "beside"), one(F.concat(F.lit("include/"), spec), "include"), one(spec, "root"))
    relative = ((language == "js") & js_relative) | ((language == "py") & (dots > 0)) | ((language == "rs") & spec.rlike(_RUST_LOCAL)) | (language.isin("c", "other") & js_relative)
    found = (
        F.when((language == "js") & ~js_relative, F.array().cast("array<struct<path:string,stage:string>>")).when(language == "js", of_js).when(language == "py", of_py)
        .when((language == "rs") & spec.rlike(_RUST_LOCAL), of_rs).when(language == "go", of_go).when(language == "c", of_c).when((language == "other") & js_relative, of_js))
    base = F.when(language == "py", py).when(language == "rs", rs).otherwise(js)
    return F.struct(language.alias("language"), relative.alias("relative"), (relative & base.isNull()).alias("escaped"), (language == "go").alias("folder"), F.filter(found, lambda c: c["path"].isNotNull()).alias("candidates"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, src, spec, dst, status, reason, language, stage) of each import of a file.

    imports: repo, src (path), spec; files: repo, path. The first of an import's candidates that exists is taken; stage tells which kind it is. What names no
    candidate that exists is unresolved if it is meant relative to the file or its crate, else external. Specs that climb out of the root stay unresolved.
    """
    i = imports.distinct().withColumn("__c", import_candidates(F.col("src"), F.col("spec"))).select("repo", "src", "spec", "__c.*")
    known = files.select("repo", "path", F.lit(False).alias("folder")).distinct()
    folders = files.filter(F.lower("path").endswith(".go")).select("repo", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path"), F.lit(True).alias("folder")).filter("path != ''").distinct()
    asked = i.select("repo", "src", "spec", "folder", F.posexplode("candidates").alias("priority", "c")).select("repo", "src", "spec", "folder", "priority", "c.path", "c.stage")
    hits = asked.join(known.unionByName(folders), ["repo", "path", "folder"]).groupBy("repo", "src", "spec").agg(F.min_by(F.struct("path", "stage"), "priority").alias("hit"))
    joined = i.join(hits, ["repo", "src", "spec"], "left")
    status = F.when(F.col("hit").isNotNull(), "resolved").when(F.col("relative"), "unresolved").otherwise("external")
    reason = F.when(status != "unresolved", None).when(F.col("escaped"), "outside_root").when(F.col("language").isin("js", "c", "other") & F.col("spec").rlike(r"\.[A-Za-z0-9]+$"), "missing_file").otherwise("missing_candidates")
    return joined.select("repo", "src", "spec", F.col("hit.path").alias("dst"), status.alias("status"), reason.alias("reason"), "language", F.col("hit.stage").alias("stage"))


def best_alias(specs: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(spec, pattern, target): the path alias that fits each spec best: fewest stars, then shortest, then least pattern."""
    order = sorted(patterns, key=lambda p: (p[0].count("*"), len(p[0]), p[0]))
    pattern, target = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p, t in reversed(order):
        head, star, tail = p.partition("*")
        fits = (F.col("spec").startswith(head) & F.col("spec").endswith(tail) & (F.length("spec") >= len(head) + len(tail))) if star else F.col("spec") == p
        middle = F.expr(f"substring(spec, {len(head) + 1}, length(spec) - {len(head) + len(tail)})") if star else F.lit("")
        pattern = F.when(fits, p).otherwise(pattern)
        target = F.when(fits, F.concat(F.lit(t.partition("*")[0]), middle, F.lit(t.partition("*")[2]))).otherwise(target)
    return specs.select("spec", pattern.alias("pattern"), target.alias("target"))
