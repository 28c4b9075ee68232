"""Batches of changes to a graph or a task board: new tables, errors, and what changed.

Entities: ref_id, name, entity_type, description, observations (array), is_root, ord. Relations: ref_id,
from_entity, to_entity, relation_type, description, ord. Requests carry ord, their order in the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERRORS = "step string, ord long, key string, reason string"
#: A task's output is cut to this many characters, the last three being dots.
OUTPUT = 150


def after_observations(observations: Column, add: Column, remove: Column) -> Column:
    """Added ones at the end, then every equal one of those to be removed gone."""
    none = F.array().cast("array<string>")
    return F.filter(F.concat(F.coalesce(observations, none), F.coalesce(add, none)), lambda o: ~F.array_contains(F.coalesce(remove, none), o))


def entity_id(name: Column | str) -> Column:
    """An id that depends on the key alone, so that a repeated run gives the same table."""
    return F.substring(F.sha2(F.concat(F.lit("entity:"), name), 256), 1, 32)


def relation_id(from_entity: Column | str, to_entity: Column | str, relation_type: Column | str) -> Column:
    return F.substring(F.sha2(F.to_json(F.array(from_entity, to_entity, relation_type)), 256), 1, 32)


def _first(df: DataFrame, *keys: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy("ord")) == 1


def _errors(df: DataFrame, step: str, key: str, reason: Column | str) -> DataFrame:
    return df.select(F.lit(step).alias("step"), F.col("ord").cast("long").alias("ord"), F.col(key).alias("key"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def _after(present: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with ord after all rows of ``present``; the next free place is one row."""
    base = present.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).cast("long").alias("base"))
    return new.crossJoin(F.broadcast(base)).withColumn("ord", F.col("base") + F.col("ord")).drop("base")


def create_entities(entities: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rows, and errors for names that exist already or come a second time in the batch."""
    marked = requests.withColumn("fresh", _first(requests, "name")).join(entities.select("name").withColumn("there", F.lit(True)), "name", "left")
    good = marked.filter("fresh and there is null")
    new = good.select(
        entity_id("name").alias("ref_id"), "name", "entity_type", "description", F.coalesce("observations", F.array().cast("array<string>")).alias("observations"), "is_root", F.col("ord").cast("long").alias("ord")
    )
    return _after(entities, new), _errors(marked.filter("not fresh or there"), "create_entities", "name", "exists")


def create_relations(entities: DataFrame, relations: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rows, and errors for missing ends (the first end first); a triple that exists is passed over silently."""
    names = entities.select("name").distinct()
    a, b = names.select(F.col("name").alias("from_entity"), F.lit(True).alias("has_from")), names.select(F.col("name").alias("to_entity"), F.lit(True).alias("has_to"))
    marked = requests.join(a, "from_entity", "left").join(b, "to_entity", "left")
    triple = ["from_entity", "to_entity", "relation_type"]
    good = marked.filter("has_from and has_to").join(relations.select(*triple), triple, "left_anti")
    good = good.withColumn("fresh", _first(good, *triple)).filter("fresh")
    new = good.select(relation_id(*triple).alias("ref_id"), *triple, "description", F.col("ord").cast("long").alias("ord"))
    missing = marked.filter("has_from is null or has_to is null").withColumn("key", F.when(F.col("has_from").isNull(), F.col("from_entity")).otherwise(F.col("to_entity")))
    reason = F.when(F.col("has_from").isNull(), "no from_entity").otherwise("no to_entity")
    return _after(relations, new), _errors(missing, "create_relations", "key", reason)


def update_entities(entities: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All entities after the updates, the names that really changed, and errors for unknown names.

    Requests: name, description, entity_type, is_root, add_observations, remove_observations; null
    leaves a field as it is. Several requests for one name apply in their order: added observations
    are appended, then every equal string to be removed goes. Adding always counts as a change.
    """
    step = F.struct("ord", "description", "entity_type", "is_root", "add_observations", "remove_observations")
    known = requests.join(entities.select("name"), "name", "left_semi")
    steps = known.groupBy("name").agg(F.sort_array(F.collect_list(step)).alias("steps"))  # one batch's requests for one entity
    fold = """aggregate(steps, struct(description as description, entity_type as entity_type, is_root as is_root, observations as observations, false as changed),
      (s, u) -> struct(
        coalesce(u.description, s.description) as description, coalesce(u.entity_type, s.entity_type) as entity_type, coalesce(u.is_root, s.is_root) as is_root,
        filter(concat(s.observations, coalesce(u.add_observations, array())), o -> not array_contains(coalesce(u.remove_observations, array()), o)) as observations,
        s.changed or coalesce(u.description <> s.description, false) or coalesce(u.entity_type <> s.entity_type, false) or coalesce(u.is_root <> s.is_root, false)
          or coalesce(size(u.add_observations) > 0, false) or exists(s.observations, o -> array_contains(coalesce(u.remove_observations, array()), o)) as changed))"""
    folded = entities.join(steps, "name", "left").withColumn("f", F.expr(f"if(steps is null, null, {fold})"))
    pick = lambda c: F.when(F.col("f").isNull(), F.col(c)).otherwise(F.col(f"f.{c}")).alias(c)
    after = folded.select("ref_id", "name", pick("entity_type"), pick("description"), pick("observations"), pick("is_root"), "ord")
    unknown = requests.join(entities.select("name"), "name", "left_anti")
    return after, folded.filter("f.changed").select("name"), _errors(unknown, "update_entities", "name", "not found")


def delete_relations(relations: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left, what went, and errors for triples that are not there."""
    triple = ["from_entity", "to_entity", "relation_type"]
    key = F.concat_ws(" ", *triple)
    return (
        relations.join(requests, triple, "left_anti"),
        relations.join(requests, triple, "left_semi"),
        _errors(requests.join(relations, triple, "left_anti").withColumn("key", key), "delete_relations", "key", "not found"),
    )


def delete_entities(entities: DataFrame, relations: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entities left, relations left, entities gone, relations gone with them, and errors for unknown names."""
    names = requests.select("name").join(entities.select("name"), "name", "left_semi").distinct()
    one, other = names.select(F.col("name").alias("from_entity")), names.select(F.col("name").alias("to_entity"))
    kept = relations.join(one, "from_entity", "left_anti").join(other, "to_entity", "left_anti")
    gone = relations.join(one, "from_entity", "left_semi").unionByName(relations.join(one, "from_entity", "left_anti").join(other, "to_entity", "left_semi"))
    unknown = requests.join(entities.select("name"), "name", "left_anti")
    return entities.join(names, "name", "left_anti"), kept, entities.join(names, "name", "left_semi"), gone, _errors(unknown, "delete_entities", "name", "not found")


@dataclass
class GraphBatch:
    """One batch; a part that is None asks for nothing."""

    create_entities: DataFrame | None = None
    create_relations: DataFrame | None = None
    update_entities: DataFrame | None = None
    delete_relations: DataFrame | None = None
    delete_entities: DataFrame | None = None


@dataclass
class GraphChange:
    entities: DataFrame
    relations: DataFrame
    errors: DataFrame
    #: op (added, modified, removed), kind (entity, relation) and ref_id.
    delta: DataFrame


def update_graph(entities: DataFrame, relations: DataFrame, batch: GraphBatch) -> GraphChange:
    """Creates entities, then relations; updates; deletes relations, then entities with their relations.

    Errors are collected and what is valid is applied. A row created and deleted in one batch is both
    added and removed; one created and updated is both added and modified. Relations are never modified.
    """
    spark = entities.sparkSession
    errors, delta = spark.createDataFrame([], ERRORS), spark.createDataFrame([], "op string, kind string, ref_id string")
    tell = lambda df, op, kind: df.select(F.lit(op).alias("op"), F.lit(kind).alias("kind"), "ref_id")
    if batch.create_entities is not None:
        new, bad = create_entities(entities, batch.create_entities)
        entities, errors, delta = entities.unionByName(new), errors.unionByName(bad), delta.unionByName(tell(new, "added", "entity"))
    if batch.create_relations is not None:
        new, bad = create_relations(entities, relations, batch.create_relations)
        relations, errors, delta = relations.unionByName(new), errors.unionByName(bad), delta.unionByName(tell(new, "added", "relation"))
    if batch.update_entities is not None:
        entities, changed, bad = update_entities(entities, batch.update_entities)
        errors, delta = errors.unionByName(bad), delta.unionByName(tell(entities.join(changed, "name", "left_semi"), "modified", "entity"))
    if batch.delete_relations is not None:
        relations, gone, bad = delete_relations(relations, batch.delete_relations)
        errors, delta = errors.unionByName(bad), delta.unionByName(tell(gone, "removed", "relation"))
    if batch.delete_entities is not None:
        entities, relations, gone, with_them, bad = delete_entities(entities, relations, batch.delete_entities)
        delta = delta.unionByName(tell(gone, "removed", "entity")).unionByName(tell(with_them, "removed", "relation"))
        errors = errors.unionByName(bad)
    return GraphChange(entities, relations, errors, delta.distinct())


def change_events(delta: DataFrame, tool_id: str, last_seq: int) -> DataFrame:
    """The delta as one event of the next seq: tool_id, seq, op, kind, ref_id; no rows for an empty delta, so seq stays."""
    return delta.select(F.lit(tool_id).alias("tool_id"), F.lit(last_seq + 1).cast("long").alias("seq"), "op", "kind", "ref_id")


def replay(events: DataFrame) -> DataFrame:
    """kind and ref_id of what is there after all events: the last word on each id counts; within one event removal does."""
    word = F.struct("seq", (F.col("op") == "removed").alias("gone"))
    last = events.groupBy("tool_id", "kind", "ref_id").agg(F.max(word).alias("last"))
    return last.filter("not last.gone").select("tool_id", "kind", "ref_id")


def gaps(events: DataFrame) -> DataFrame:
    """tool_id and seq of events whose predecessor is missing."""
    seqs = events.select("tool_id", "seq").distinct()
    before = seqs.select("tool_id", (F.col("seq") + 1).alias("seq"))
    return seqs.filter("seq > 1").join(before, ["tool_id", "seq"], "left_anti")


def embedding_text(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """ref_id and the text to embed: of every entity, and of relations that are described."""
    e = entities.select("ref_id", F.concat("name", F.lit(": "), "description").alias("text"))
    r = relations.filter(F.coalesce("description", F.lit("")) != "")
    return e.unionByName(r.select("ref_id", F.concat(F.concat_ws(" ", "from_entity", "relation_type", "to_entity"), F.lit(": "), "description").alias("text")))


def shortened(text: Column | str, most: int = OUTPUT) -> Column:
    """A text of more than ``most`` characters is cut, its last three characters being dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(F.col(text) if isinstance(text, str) else text)


def update_board(tasks: DataFrame, create: DataFrame | None = None, update: DataFrame | None = None, delete: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Tasks (id, status, description, owner, creator, output, ord) after a batch, and its errors.

    Creates append, even under an id that is there. An update overwrites the first task of its id with
    its non-null fields, the last request's word counting; a delete removes all tasks of an id.
    """
    spark, errors, fields = tasks.sparkSession, [], ("status", "description", "owner", "output")
    if create is not None:
        new = create.withColumn("output", shortened("output")).select(*tasks.columns)
        tasks = tasks.unionByName(_after(tasks, new).select(*tasks.columns))
    if update is not None:
        said = update.groupBy("id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"new_{c}") for c in fields))
        firsts = tasks.groupBy("id").agg(F.min("ord").alias("first"))
        joined = tasks.join(firsts.join(said, "id"), "id", "left")
        pick = lambda c: F.when(F.col("ord") == F.col("first"), F.coalesce(f"new_{c}", c)).otherwise(F.col(c))
        errors.append(_errors(update.join(tasks, "id", "left_anti").withColumn("key", F.col("id").cast("string")), "update", "key", "not found"))
        columns = [(shortened(pick(c)) if c == "output" else pick(c)).alias(c) if c in fields else F.col(c) for c in tasks.columns]
        tasks = joined.select(*columns)
    if delete is not None:
        errors.append(_errors(delete.join(tasks, "id", "left_anti").withColumn("key", F.col("id").cast("string")), "delete", "key", "not found"))
        tasks = tasks.join(delete, "id", "left_anti")
    out = spark.createDataFrame([], ERRORS)
    for e in errors:
        out = out.unionByName(e)
    return tasks, out
