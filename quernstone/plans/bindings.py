"""Roles that the operators take, derived from the tables of a folder.

Each role is one SELECT whose few dialect-dependent parts come from a small table, so that Spark
and the checking engine derive the same rows. AS_OF is the fixed "now" of all queries.
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import Index, lengths, packed_postings, unpacked
from ..operators.text_index import Trigrams, trigram_index
from ..sources.stored import file_marks, stored

AS_OF = datetime(2024, 3, 1)
AS_OF_SQL = "TIMESTAMP '2024-03-01 00:00:00'"

#: Dialect-dependent pieces: later(time, n, unit), list of strings, text of a number, hash.
SPARK = {
    "later": lambda t, n, unit: f"timestampadd({unit}, CAST({n} AS INT), {t})",
    "epoch": "TIMESTAMP_NTZ '2024-01-01 00:00:00'",
    "list": lambda *x: f"array({', '.join(x)})",
    "text": lambda x: f"CAST({x} AS STRING)",
    "json_int": lambda c, k: f"CAST(get_json_object({c}, '$.{k}') AS BIGINT)",
    "split_last": lambda c, sep: f"element_at(split({c}, '{sep}'), -1)",
    "day": lambda c: f"CAST({c} AS DATE)",
    "lines": lambda c: f"split({c}, '\\n')",
}
DUCK = {
    "later": lambda t, n, unit: f"({t} + to_{unit.lower()}s(CAST({n} AS INTEGER)))",
    "epoch": "TIMESTAMP '2024-01-01 00:00:00'",
    "list": lambda *x: f"[{', '.join(x)}]",
    "text": lambda x: f"CAST({x} AS VARCHAR)",
    "json_int": lambda c, k: f"CAST({c}->>'$.{k}' AS BIGINT)",
    "split_last": lambda c, sep: f"list_last(string_split({c}, '{sep}'))",
    "day": lambda c: f"CAST({c} AS DATE)",
    "lines": lambda c: f"string_split({c}, chr(10))",
}


def _memories(d: dict) -> str:
    t = d["later"](d["epoch"], "d.doc_id % 2000", "HOUR")
    return f"""SELECT d.doc_id AS id, 'MEM-' || lpad({d["text"]("d.doc_id")}, 6, '0') AS code, d.source AS repo,
  CASE WHEN d.doc_id % 3 = 0 THEN 'org' ELSE 'team' END AS owner,
  CASE d.doc_id % 5 WHEN 0 THEN 'code_fact' WHEN 1 THEN 'decision' WHEN 2 THEN 'mistake' WHEN 3 THEN 'pattern' ELSE 'task_archive' END AS type,
  substr(d.text, 1, 60) AS title, d.text AS content, CAST(1 + d.doc_id % 5 AS INT) AS importance, d.lang AS language,
  'src/' || d.source AS folder, CASE WHEN d.doc_id % 2 = 0 THEN 'main' ELSE 'dev' END AS branch,
  {t} AS created_at, {d["later"](t, "d.doc_id % 48", "HOUR")} AS updated_at,
  CAST(d.n_chars % 20 AS INT) AS hit_count, CAST(coalesce(l.quality, 0) * (d.n_chars % 7) AS INT) AS recall_count,
  CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE {d["later"](t, "d.doc_id % 30", "DAY")} END AS last_used_at,
  CASE WHEN d.doc_id % 7 = 0 THEN {d["later"](t, "30", "DAY")} END AS expires_at,
  CASE WHEN d.doc_id % 11 = 0 THEN 'archived' ELSE 'active' END AS status, d.doc_id % 13 = 0 AS is_global,
  {d["list"]("d.lang", "d.source", f"'Tag{{}}' || {d['text']('d.doc_id % 6')}".replace("{}", ""))} AS tags
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def _standards(d: dict) -> str:
    t = d["later"](d["epoch"], "doc_id % 900", "HOUR")
    return f"""SELECT doc_id AS id, 'STD-' || lpad({d["text"]("doc_id")}, 6, '0') AS code, substr(coalesce(text, ''), 1, 50) AS title, coalesce(text, '') AS content,
  CASE WHEN doc_id % 3 = 0 THEN 'api' WHEN doc_id % 3 = 1 THEN 'testing' ELSE 'style' END AS context, '1.' || {d["text"]("doc_id % 3")} AS version,
  coalesce(lang, 'und') AS language, {d["list"]("'stack' || " + d["text"]("doc_id % 4"), "'stack' || " + d["text"]("doc_id % 6"))} AS stack,
  {d["list"]("coalesce(source, '')", "coalesce(lang, 'und')")} AS tags, source AS repo, doc_id % 5 = 0 AS is_global, {t} AS created_at, {d["later"](t, "doc_id % 72", "HOUR")} AS updated_at,
  CASE WHEN doc_id % 2 = 0 THEN {d["later"](t, "doc_id % 20", "DAY")} END AS last_used_at, CAST(n_chars % 9 AS INT) AS hit_count
FROM documents"""


def _tasks(d: dict) -> str:
    return f"""SELECT o.o_orderkey AS id, 'TASK-' || lpad({d["text"]("o.o_orderkey")}, 7, '0') AS task_code,
  'repo' || {d["text"]("o.o_custkey % 10")} AS repo, CASE WHEN o.o_custkey % 2 = 0 THEN 'org' ELSE 'team' END AS owner,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'Design' WHEN 1 THEN 'build' WHEN 2 THEN 'test' ELSE 'Release' END AS phase,
  'Handle order ' || {d["text"]("o.o_orderkey")} || ' for customer ' || {d["text"]("o.o_custkey")} || CASE WHEN o.o_orderkey % 9 = 0 THEN ' [#' || {d["text"]("o.o_custkey")} || ']' ELSE '' END AS title,
  'Priority ' || o.o_orderpriority || ', discussed issue ' || {d["text"]("o.o_custkey % 50")} AS description,
  CASE WHEN o.o_orderstatus = 'F' THEN CASE WHEN o.o_orderkey % 17 = 0 THEN 'canceled' ELSE 'completed' END WHEN o.o_orderstatus = 'O' THEN CASE WHEN o.o_orderkey % 7 = 0 THEN 'blocked' ELSE 'in_progress' END
       ELSE CASE WHEN o.o_orderkey % 2 = 0 THEN 'pending' ELSE 'backlog' END END AS status,
  CAST(6 - CAST(substr(o.o_orderpriority, 1, 1) AS INT) AS INT) AS priority, o.o_orderdate AS created_at,
  {d["later"]("o.o_orderdate", "o.o_orderkey % 90", "DAY")} AS updated_at,
  CASE WHEN o.o_orderstatus <> 'P' THEN {d["later"]("o.o_orderdate", "o.o_orderkey % 5", "DAY")} END AS in_progress_at,
  CASE WHEN o.o_orderstatus = 'F' THEN {d["later"]("o.o_orderdate", "o.o_orderkey % 5 + o.o_orderkey % 40", "DAY")} END AS finished_at,
  CAST(floor(o.o_totalprice / 100) AS BIGINT) AS est_tokens,
  CASE WHEN o.o_orderkey % 6 = 0 THEN CAST(floor(o.o_orderkey / 2) AS BIGINT) END AS parent_id,
  CASE WHEN o.o_orderkey % 5 = 0 THEN CAST(floor(o.o_orderkey / 3) AS BIGINT) END AS depends_on
FROM orders o"""


def _claims(d: dict) -> str:
    return f"""SELECT l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS id, l_orderkey AS task_id, 'agent' || {d["text"]("l_suppkey % 40")} AS agent,
  l_shipdate AS claimed_at, CASE WHEN l_linestatus = 'F' THEN {d["later"]("l_shipdate", "3", "DAY")} END AS released_at, 'repo' || {d["text"]("l_suppkey % 10")} AS repo FROM lineitem"""


def _handoffs(d: dict) -> str:
    return f"""SELECT l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 AS id, l_orderkey AS task_id, 'agent' || {d["text"]("l_suppkey % 40")} AS from_agent, 'agent' || {d["text"]("l_partkey % 40")} AS to_agent,
  CASE l_returnflag WHEN 'R' THEN 'expired' WHEN 'A' THEN 'accepted' ELSE 'pending' END AS status, l_shipdate AS created_at, 'repo' || {d["text"]("l_suppkey % 10")} AS repo FROM lineitem"""


def _actions(d: dict) -> str:
    return f"""SELECT event_id AS id, event_type AS action, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'q' || {d["text"]("user_id % 4")} END AS query, user_id % 20 AS memory_id, user_id,
  {d["json_int"]("props", "k")} AS result_count, ts AS created_at, value, 'src' || {d["text"]("user_id % 20")} AS repo FROM events"""


def _vectors(d: dict) -> str:
    return f"SELECT vec_id AS id, embedding AS vector, 'repo' || {d['text']('label')} AS repo, {d['later'](d['epoch'], 'vec_id % 600', 'HOUR')} AS updated_at FROM embeddings"


#: The graph has two repositories: suppliers stand in one of them, nations, regions and brands in both, so names are shared.
GRAPHS = "CROSS JOIN (SELECT 'kg0' AS repo UNION ALL SELECT 'kg1' AS repo) g"


def _entities(d: dict) -> str:
    return f"""SELECT 'supplier ' || {d["text"]("s_suppkey")} AS name, 'supplier' AS type, s_name AS description, 'kg' || {d["text"]("s_suppkey % 2")} AS repo, {d["later"](d["epoch"], "s_suppkey", "HOUR")} AS created_at FROM supplier
UNION ALL SELECT 'nation ' || n_name, 'nation', n_name, g.repo, {d["later"](d["epoch"], "n_nationkey", "DAY")} FROM nation {GRAPHS}
UNION ALL SELECT 'region ' || r_name, 'region', r_name, g.repo, {d["epoch"]} FROM region {GRAPHS}
UNION ALL SELECT 'brand ' || p_brand, 'brand', min(p_name), g.repo, {d["epoch"]} FROM part {GRAPHS} GROUP BY p_brand, g.repo"""


def _relations(d: dict) -> str:
    return f"""SELECT DISTINCT 'supplier ' || {d["text"]("l.l_suppkey")} AS from_entity, 'brand ' || p.p_brand AS to_entity, CASE l.l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'supplied' ELSE 'supplies' END AS relation_type, 'kg' || {d["text"]("l.l_suppkey % 2")} AS repo,
  CASE l.l_returnflag WHEN 'R' THEN 0.55 WHEN 'A' THEN 0.8 ELSE 1.0 END AS confidence FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
UNION ALL SELECT 'supplier ' || {d["text"]("s_suppkey")}, 'nation ' || n_name, 'located_in', 'kg' || {d["text"]("s_suppkey % 2")}, 1.0 FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'nation ' || n_name, 'region ' || r_name, 'part_of', g.repo, 1.0 FROM nation JOIN region ON n_regionkey = r_regionkey {GRAPHS}"""


def _observations(d: dict) -> str:
    return f"""SELECT event_id AS id, 'supplier ' || {d["text"]("user_id % 60 + 1")} AS entity_name, event_type || ' ' || {d["text"]("event_id % 7")} AS observation, 'kg' || {d["text"]("(user_id % 60 + 1) % 2")} AS repo, ts AS created_at FROM events"""


def _files(d: dict) -> str:
    return f"""SELECT page_id AS id, 'site' || {d["text"]("page_id % 3")} AS repo, 'p' || {d["text"]("page_id % 7")} || '/q' || {d["text"]("page_id % 3")} || '/f' || {d["text"]("page_id")} || CASE page_id % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.md' ELSE '.html' END AS file_path, html AS content,
  CASE page_id % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN NULL ELSE 'html' END AS language, length(html) AS size_bytes,
  'c' || {d["text"]("page_id % 40")} AS checksum, {d["later"](d["epoch"], "page_id % 300", "HOUR")} AS last_indexed_at FROM pages"""


def _symbols(d: dict) -> str:
    return f"""SELECT p_partkey AS id, 'site' || {d["text"]("p_partkey % 3")} AS repo, 'p' || {d["text"]("p_partkey % 7")} || '/q' || {d["text"]("p_partkey % 3")} || '/f' || {d["text"]("p_size")} || '.ts' AS file_path,
  CASE p_partkey % 4 WHEN 0 THEN 'getPart' WHEN 1 THEN 'setPart' WHEN 2 THEN 'part' ELSE 'PartOf' END || {d["text"]("p_partkey % 300")} AS name,
  CASE p_partkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' WHEN 3 THEN 'interface' ELSE 'variable' END AS kind, p_size % 2 = 1 AS exported,
  CAST(p_partkey % 90 + 1 AS INT) AS start_line, CAST(p_partkey % 90 + 1 + p_size % 40 AS INT) AS end_line, p_name || '()' AS signature,
  CASE WHEN p_partkey % 3 = 0 THEN 'makes part' || {d["text"]("p_partkey % 50")} END AS doc_comment,
  CASE WHEN p_partkey % 5 = 2 THEN p_partkey - 2 END AS parent_symbol_id FROM part"""


def _references(d: dict) -> str:
    return f"""SELECT l_orderkey * 10 + l_linenumber AS id, 'site' || {d["text"]("l_partkey % 3")} AS repo, CASE l_partkey % 4 WHEN 0 THEN 'getPart' WHEN 1 THEN 'setPart' WHEN 2 THEN 'part' ELSE 'PartOf' END || {d["text"]("l_partkey % 250")} AS symbol_name,
  'p' || {d["text"]("l_suppkey % 7")} || '/q' || {d["text"]("l_suppkey % 3")} || '/f' || {d["text"]("l_suppkey % 50 + 1")} || '.ts' AS caller_file, CAST(l_quantity AS INT) AS caller_line,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'setPart' || {d["text"]("l_suppkey % 300")} END AS caller_name, CASE l_returnflag WHEN 'R' THEN 'import' WHEN 'A' THEN 'type' ELSE 'call' END AS kind,
  CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS target_symbol_id,
  CASE WHEN l_linenumber % 2 = 1 THEN 'p' || {d["text"]("l_partkey % 7")} || '/q' || {d["text"]("l_partkey % 3")} || '/f' || {d["text"]("l_suppkey % 50 + 1")} || '.ts' END AS target_file FROM lineitem"""


def _jobs(d: dict) -> str:
    return f"""SELECT event_id AS id, event_type AS entity_kind, {d["text"]("user_id")} AS entity_id, CASE event_id % 5 WHEN 0 THEN 'claimed' WHEN 1 THEN 'done' WHEN 2 THEN 'poison' ELSE 'pending' END AS status, CAST(event_id % 6 AS INT) AS attempts,
  CASE WHEN event_id % 5 = 0 THEN {d["later"]("ts", "40", "DAY")} END AS lease_until, CASE WHEN event_id % 4 = 3 THEN {d["later"]("ts", "45", "DAY")} END AS backoff_until,
  'h' || {d["text"]("event_id % 3")} AS content_hash, ts AS created_at, ts AS updated_at FROM events"""


def _mentions(d: dict) -> str:
    return f"""SELECT conv_id AS doc, lower(role) || ' ' || {d["text"]("turn % 4")} AS name, CAST(turn AS INT) AS pos FROM conversations"""


ROLES = {f.__name__[1:]: f for f in (_memories, _standards, _tasks, _claims, _handoffs, _actions, _vectors, _entities, _relations, _observations, _files, _symbols, _references, _jobs, _mentions)}
ROLES["refs"] = ROLES.pop("references")  # "references" is a reserved word
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_trigrams: dict[tuple, Trigrams] = {}


def duck_sql(role: str) -> str:
    return ROLES[role](DUCK)


class Tables:
    """The tables of a folder and the roles over them; everything is lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def as_of(self) -> Column:
        return F.lit(AS_OF).cast("timestamp_ntz")

    def index(self, role: str, *columns: str) -> Index:
        """The stored full-text index of some columns of a role, made once an application."""
        df = getattr(self, role).select("id", F.concat_ws(" ", *(F.array_join(c[:-2], " ") if c.endswith("[]") else F.col(c) for c in columns)).alias("body"))
        marks = tuple(file_marks(self.spark, f"{self.folder}/{t}.parquet") for t in self.sources(role))
        key = (self.folder, role, *columns, marks)
        return Index(unpacked(stored(self.spark, (*key, "postings"), lambda: packed_postings(df))), stored(self.spark, (*key, "lengths"), lambda: lengths(df)))

    def trigrams(self, name: str, df: DataFrame, role: str, columns: list[str], keep: list[str]) -> Trigrams:
        """The trigram index of some columns of rows made of a role, made once an application and state of the role's tables."""
        marks = tuple(file_marks(self.spark, f"{self.folder}/{t}.parquet") for t in self.sources(role))
        key = (self.spark.sparkContext.applicationId, self.folder, name, *columns, *keep, marks)
        if key not in _trigrams:
            _trigrams[key] = trigram_index(df, columns, keep=keep)
        return _trigrams[key]

    def sources(self, role: str) -> list[str]:
        """The tables that a role reads."""
        return [t for t in TABLES if re.search(rf"(?:FROM|JOIN) {t}\b", ROLES[role](SPARK))]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, role: str) -> DataFrame:
        if role not in ROLES:
            raise AttributeError(role)
        sql = ROLES[role](SPARK)
        used = self.sources(role)
        for t in used:
            sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        return self.spark.sql(sql, **{t: self.table(t) for t in used})
