"""Command line: python -m loomgraph.cli COMMAND ... Exit codes: 0 done, 1 bad input, 3 unreadable source, 4 model failure,
5 compile failure, 8 failed gates. Services that need a network have local stand-ins; a model is given as module:function.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from pyspark.sql import Window, functions as F

from . import schemas
from .functions import ids
from .operators import canonicalize, compile as compile_, densify, gates, search, typed
from .session import prepare, saver, session
from .sources import files, profile, sinks

CODES = {"input": 1, "source": 3, "model": 4, "compile": 5, "gates": 8}


class Stop(Exception):
    def __init__(self, kind: str, text: str):
        super().__init__(text)
        self.code = CODES[kind]


def need(path: str, kind: str = "input") -> str:
    if not os.path.exists(path):
        raise Stop(kind, f"{path} does not exist")
    return path


def imported(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def tables_of(spark, folder: str) -> dict:
    return {n: sinks.read_table(spark, n, need(folder)) for n in schemas.DECLARED}


def graph_frames(docs, names=("entities", "relationships", "document_elements")) -> list:
    out = []
    for n in names:
        out.append(files.exploded(docs, n).withColumn("doc", F.col("file_ord")))
    return out


def init(a) -> None:
    for part in ("source", "enriched", "parquet", "ontology", "search"):
        os.makedirs(os.path.join(a.folder, part), exist_ok=True)


def set_domain(a) -> None:
    if bool(a.prompt) == bool(a.file):
        raise Stop("input", "give a prompt or a file, not both")
    path = os.path.join(a.folder, "domain.json")
    if os.path.exists(path) and not a.force:
        print(f"{path} is kept")
        return
    brief = {"brief": a.prompt} if a.prompt else json.load(open(need(a.file), encoding="utf-8"))
    with open(path, "w", encoding="utf-8") as f:
        json.dump(brief, f, indent=1)


def inspect_source(a) -> None:
    spark = session("inspect")
    prepare(spark)
    found = files.binary_files(spark, need(a.path))
    if not found.take(1):
        raise Stop("source", "no supported file")
    rows = files.element_rows(files.elements(found), files.source_rows(found))
    profile.inventory(rows).orderBy("source_file_id", "element_type").show(1000, False)
    profile.total_inventory(rows).show()


def enrich(a) -> None:
    """Files to stored answers of a model: one JSON row for each section, with chunks and their evidence beside them."""
    spark = session("enrich")
    prepare(spark)
    found = files.binary_files(spark, need(a.path))
    sources = files.source_rows(found)
    elements = files.element_rows(files.elements(found), sources)
    chunks = files.chunk_rows(elements)
    tables = {"source_files": sources, "document_elements": elements, "chunks": compile_.keep_first(chunks.withColumns({"file_ord": F.lit(0), "pos": F.lit(0)}), "chunk_id").drop("file_ord", "pos")}
    tables["evidence"] = schemas.conform(canonicalize.text_evidence(tables["chunks"], F.current_timestamp()), "evidence")
    if a.model:
        answers = f"{a.out}/answers"
        done = sinks.completed(spark, f"{a.out}/completed")
        todo = canonicalize.section_batches(elements).withColumn("key", F.concat_ws("#", "source_file_id", "section")).join(done, "key", "left_anti")
        try:  # paid calls are made once: the answers are a table before anything reads them
            canonicalize.batches_to_model(todo, imported(a.model)).write.mode("append").parquet(answers)
        except Exception as e:
            raise Stop("model", str(e)[:500]) from e
        payloads = spark.read.parquet(answers)
        sinks.mark_completed(payloads.select(F.concat_ws("#", "source_file_id", "section").alias("key")), f"{a.out}/completed")
        good, _ = canonicalize.valid_entities(payloads)
        now = F.current_timestamp()
        entity = canonicalize.merged_entities(good).withColumns({"is_placeholder": F.lit(False), "content_hash": ids.content_hash("canonical_key"), "created_at": now, "updated_at": now})
        order = entity.select("source_file_id").distinct().withColumn("file_ord", F.row_number().over(Window.orderBy("source_file_id")))  # one short row a file
        entity = entity.join(order, "source_file_id")
        tables["entities"] = schemas.conform(compile_.merge_entities(schemas_loaded(entity, "entities")).drop("file_ord", "pos"), "entities", strict=False)
        rel = canonicalize.resolved_relations(canonicalize.valid_relations(payloads)[0], good).withColumns({"is_placeholder": F.lit(False), "content_hash": F.sha2(ids.joined(F.col("relationship_type"), F.col("source_entity_id"), F.col("target_entity_id")).cast("binary"), 256), "created_at": now, "file_ord": F.lit(0)})
        tables["relationships"] = schemas.conform(compile_.keep_first(rel, "relationship_id").drop("file_ord", "pos", "source_file_id"), "relationships", strict=False)
    sinks.write_tables(tables, f"{a.out}/parquet")


def schemas_loaded(df, name: str):
    """df with every declared column, its ordinals kept."""
    plain = schemas.open_schema(name)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in plain if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def densify_(a) -> None:
    spark = session("densify")
    docs = files.enriched_documents(spark, need(a.path), "*_canonical.json")
    save = saver(spark, f"{a.out}/_work")
    entities, edges, elements = map(save, graph_frames(docs))
    new = densify.densify(entities, edges, elements, a.max_models, a.link_scr, a.link_steps, a.link_rca, saver(spark, f"{a.out}/_work"))
    sinks.write_table(densify.added(new, F.lit(a.at).cast("timestamp") if a.at else F.current_timestamp()).dropDuplicates(["relationship_id"]), "relationships", a.out)


def compile_data(a) -> None:
    spark = session("compile")
    loaded = files.loaded(files.enriched_documents(spark, need(a.path)))
    if a.added:
        extra = sinks.read_table(spark, "relationships", a.added).withColumns({"file_ord": F.lit(2**30), "pos": F.lit(0)})
        loaded["relationships"] = compile_.coerce_timestamps(loaded["relationships"], "relationships").unionByName(extra, allowMissingColumns=True)
    try:
        sinks.write_tables(compile_.guarded_compile(loaded, gates.data_gates), a.out)
    except (compile_.CompileError, sinks.NotNullError) as e:
        raise Stop("compile", str(e)) from e


def compile_ontology(a) -> None:
    spark = session("ontology")
    t = tables_of(spark, a.path)
    plan = typed.build_plan(t["entities"], t["relationships"], min_pair_count=a.min_pair_count, max_pairs=a.max_pairs)
    os.makedirs(a.out, exist_ok=True)
    for part in typed.parts(plan, a.name, a.single):
        path = os.path.join(a.out, part["path"])
        os.makedirs(os.path.dirname(path), exist_ok=True)
        import base64

        with open(path, "wb") as f:
            f.write(base64.b64decode(part["payload"]))
    with open(os.path.join(a.out, "grounding.md"), "w", encoding="utf-8") as f:
        f.write(typed.grounding(plan))


def compile_search(a) -> None:
    spark = session("search")
    t = tables_of(spark, a.path)
    for name, docs, key in (("chunks", search.chunk_docs(t["chunks"], t["entities"], t["source_files"]), "chunk_id"), ("elements", search.element_docs(t["document_elements"]), "document_element_id")):
        docs = search.mock_vectors(docs) if a.mock_vectors else docs
        sinks.write_search_docs(docs, search.index_schema(name, docs, key, "vector" if a.mock_vectors else None), a.out)


def validate(a) -> None:
    found = gates.suite(tables_of(session("validate"), a.path), a.strict)
    if a.rules:
        found = gates.only(found, a.rules.split(","))
    for r in found.orderBy("rule", "key").limit(1000).collect():
        print(f"[{r['rule']}] {r['severity'].upper()} {r['table']} {r['key']}: {r['message']}")
    if code := gates.exit_code(found):
        raise Stop("gates", f"failed gates (exit {code})")


def deploy_tables(a) -> None:
    for name, status in sinks.write_lakehouse(tables_of(session("deploy"), a.path), a.database, dry_run=a.dry_run).items():
        print(f"{name}: {status}")


def package(a) -> None:
    try:
        sinks.package(need(a.path), a.out)
    except FileNotFoundError as e:
        raise Stop("input", str(e)) from e


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomgraph")
    sub = top.add_subparsers(required=True)

    def command(name: str, run, *args):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for names, options in args:
            p.add_argument(*names.split(), **options)

    path, out = ("path", {}), ("--out", {"required": True})
    command("init", init, ("folder", {}))
    command("set-domain", set_domain, ("folder", {}), ("--prompt", {}), ("--file", {}), ("--force", {"action": "store_true"}))
    command("inspect-source", inspect_source, path)
    command("enrich", enrich, path, out, ("--model", {"help": "module:function, prompts to JSON texts"}))
    flag = {"action": argparse.BooleanOptionalAction, "default": True}
    command("densify", densify_, path, out, ("--max-models", {"type": int, "default": 5}), ("--link-scr", flag), ("--link-steps", flag), ("--link-rca", flag), ("--at", {}))
    command("compile-data", compile_data, path, out, ("--added", {}))
    command("compile-ontology", compile_ontology, path, out, ("--name", {"default": "graph"}), ("--single", {"action": "store_true"}), ("--min-pair-count", {"type": int, "default": 10}), ("--max-pairs", {"type": int, "default": 40}))
    command("compile-search", compile_search, path, out, ("--mock-vectors", {"action": "store_true"}))
    command("validate", validate, path, ("--rules", {}), ("--strict", {"action": "store_true"}))
    command("deploy-tables", deploy_tables, path, ("--database", {}), ("--dry-run", {"action": "store_true"}))
    command("package", package, path, out)
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        a.run(a)
    except Stop as e:
        print(e, file=sys.stderr)
        return e.code
    return 0


if __name__ == "__main__":
    sys.exit(main())
