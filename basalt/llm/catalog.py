"""The operator queries with their production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession

from basalt.llm.common import documents, shared_folder


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basalt.llm.language import identify

    return identify(documents(spark, sf_dir), P.path("byte_bpe_multi_50k.tiktoken"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basalt.llm.simhash import near_groups

    return near_groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basalt.llm.packing import pack, packed_digest

    return packed_digest(pack(documents(spark, sf_dir), P.path("word_bpe_49k.json")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basalt.llm.exact import exact_groups

    return exact_groups(documents(spark, sf_dir)).drop("row_id")


OP4_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents)
select doc_id,
  first_value(doc_id) over (partition by norm order by size desc, doc_id) as keep_id,
  count(*) over (partition by norm) as group_size,
  row_number() over (partition by norm order by size desc, doc_id) = 1 as kept,
  sha256(norm) as text_sha256
from d
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basalt.llm.quality import quality_scores

    return quality_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basalt.llm.tokens import read_token_files, token_index, write_token_files

    path = shared_folder(spark, "tokens.orc")
    write_token_files(documents(spark, sf_dir), path, P.path("word_bpe_49k.json"))
    return token_index(read_token_files(spark, path))


def op7_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basalt.llm.recurrent import lm_scores

    return lm_scores(documents(spark, sf_dir))


def op8_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basalt.llm.vptree import nearest

    return nearest(documents(spark, sf_dir, "embeddings"))


OP8_SQL = """
with v as (
  select row_number() over () as row, vec_id, embedding::double[] as x from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
    and len(list_filter(embedding, lambda e: e <> 0)) > 0),
pairs as (
  select q.row, q.vec_id as query_id, c.vec_id, list_distance(q.x, c.x) as score
  from v q, v c where q.vec_id % 100 = 0 and q.row <> c.row)
select query_id, rank, vec_id, score
from (select *, cast(row_number() over (partition by row order by score, vec_id) as integer) as rank from pairs)
where rank <= 10
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basalt.llm.toxicity import toxicity_scores

    return toxicity_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basalt.llm.bpe import bpe_round_trip

    return bpe_round_trip(documents(spark, sf_dir), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basalt.llm.pieces import piece_round_trip

    return piece_round_trip(documents(spark, sf_dir), P.path("piece_bpe_32k.model"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basalt.llm.merkle import manifest

    return manifest(documents(spark, sf_dir))


#: The trees are built from below by the same widths; the crc32 of a decimal number is spelt out by its table of 16 steps.
OP12_SQL = r"""
with recursive crc(row, rest, state) as (
    select row_number() over (), cast(doc_id as varchar), 4294967295::bigint from documents
  union all
    select row, rest[2:], xor(s1 >> 4, (case s1 & 15 %CASES% end)::bigint)
    from (select row, rest, xor(s0 >> 4, (case s0 & 15 %CASES% end)::bigint) as s1
          from (select row, rest, xor(state, ascii(rest[1])::bigint) as s0 from crc where rest <> ''))),
given as (select row_number() over () as row, * from documents),
spelt as (
  select d.row, coalesce('1' || lang, '0') as tree, doc_id,
    %VALUES% as named, coalesce(strlen(text) || ':' || text, '-') as own,
    case when c.state is not null and xor(c.state, 4294967295) % 3 = 0
      then coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') else coalesce(strlen(text) || ':' || text, '-') end as other
  from given d left join (select * from crc where rest = '') c using (row)),
leaves as (
  select tree, doc_id, sha256(named || own) as leaf, sha256(named || other) as changed,
    row_number() over (partition by tree order by doc_id nulls first, sha256(named || own), row) - 1 as pos, count(*) over (partition by tree) as n
  from spelt),
below(tree, level, pos, n, digest) as (
    select tree, 0, pos, n, leaf from leaves
  union all
    select tree, level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' order by pos)) from below where n > 1 group by tree, level, pos // 8),
subroots as (select tree, level, digest, row_number() over (order by tree) - 1 as pos, count(*) over () as n from below where n = 1),
above(level, pos, n, digest) as (
    select 0, pos, n, digest from subroots
  union all
    select level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' order by pos)) from above where n > 1 group by level, pos // 8),
nodes as (
  select tree, level, pos, digest, n, tree as up_tree, level + 1 as up_level, pos // 8 as up_pos from below where n > 1
  union all
  select '', level, pos, digest, n, '', level + 1, pos // 8 from above where n > 1
  union all
  select b.tree, b.level, 0, s.digest, s.n, '', 1, s.pos // 8 from below b join subroots s on b.tree = s.tree and b.level = s.level where s.n > 1),
places as (select *, case when tree <> '' and up_tree = '' then (select s.pos from subroots s where s.tree = nodes.tree) else pos end as place from nodes),
beside as (
  select tree, level, pos, up_tree, up_level, up_pos,
    coalesce(string_agg(digest, '') over (partition by up_tree, up_level, up_pos order by place rows between unbounded preceding and 1 preceding), '') as before,
    coalesce(string_agg(digest, '') over (partition by up_tree, up_level, up_pos order by place rows between 1 following and unbounded following), '') as after
  from places where not (tree = '' and level = 0)),
climb(tree, doc_id, leaf, k, at_tree, at_level, at_pos, folded, proof) as (
    select tree, doc_id, leaf, pos, tree, 0, pos, changed, '' from leaves
  union all
    select c.tree, c.doc_id, c.leaf, c.k, b.up_tree, b.up_level, b.up_pos, sha256(before || folded || after), proof || before || after
    from climb c join beside b on c.at_tree = b.tree and c.at_level = b.level and c.at_pos = b.pos)
select c.doc_id, c.leaf, s.digest as subroot, r.digest as root, sha256(c.proof) as proof_sha256, c.folded as folded_root, c.folded = r.digest as verified
from climb c join subroots s on c.tree = s.tree, (select digest from above where n = 1) r
where not exists (select 1 from beside b where c.at_tree = b.tree and c.at_level = b.level and c.at_pos = b.pos)
"""


def _crc_steps(bits: int = 4, polynomial: int = 0xEDB88320) -> str:
    """The table of crc32 for steps of four bits, as the branches of a case."""
    table = []
    for i in range(1 << bits):
        for _ in range(bits):
            i = i >> 1 ^ (polynomial if i & 1 else 0)
        table.append(i)
    return " ".join(f"when {i} then {x}" for i, x in enumerate(table))


_NAMED = " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars"))
OP12_SQL = OP12_SQL.replace("%CASES%", _crc_steps()).replace("%VALUES%", _NAMED)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basalt.llm.align import aligned

    return aligned(documents(spark, sf_dir), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


def queries() -> dict:
    own = (op1_language_id, op2_simhash, op3_packing, op4_exact_dedup, op5_quality, op6_token_files, op7_recurrent_lm, op8_vptree, op9_toxicity, op10_byte_bpe)
    own += (op11_piece_bpe, op12_merkle, op13_alignment)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op8_vptree": OP8_SQL, "op12_merkle": OP12_SQL}
