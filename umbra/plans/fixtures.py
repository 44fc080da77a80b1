"""Prompts and replies derived from the event table, in SQL that Spark and DuckDB share.

``rid`` tells rows apart. Some rows repeat a (session_id, seq), have no session
or no text; texts hold all five kinds, spans that overlap, front matter, keys,
text past ASCII and pseudonyms typed by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..tables import spread

_S = "CASE WHEN event_id % 97 = 0 THEN NULL ELSE 's' || CAST(user_id AS STRING) END"
PROMPTS = f"""SELECT event_id * 2 AS rid, {_S} AS session_id, event_id AS seq,
  CASE CAST(event_id % 14 AS INT)
    WHEN 0 THEN 'mail user' || CAST(event_id % 11 AS STRING) || '@example.com about /home/u' || CAST(user_id AS STRING) || '/' || event_type || '.log'
    WHEN 1 THEN 'see https://h' || CAST(event_id % 5 AS STRING) || '.example.org/' || event_type || ' from 10.0.' || CAST(user_id % 250 AS STRING) || '.' || CAST(event_id % 9 AS STRING)
    WHEN 2 THEN 'my doctor said user' || CAST(event_id % 11 AS STRING) || '@example.com, cc user' || CAST(event_id % 3 AS STRING) || '@example.com'
    WHEN 3 THEN 'deploy with API_TOKEN_' || CAST(user_id AS STRING) || '=abcdef' || CAST(event_id AS STRING)
    WHEN 4 THEN CASE WHEN event_id % 3 = 0 THEN 'compare IP_1 IP_2 IP_3 IP_4 IP_5 and IP_6' ELSE 'no identifiers in this ' || event_type || ' prompt' END
    WHEN 5 THEN 'met Dr. Smith then Smith in Paris with Alice from Acme, alice@acme.io'
    WHEN 6 THEN 'record 550e8400-e29b-41d4-a716-4466' || lpad(CAST(event_id % 40 AS STRING), 8, '0') || ' failed'
    WHEN 7 THEN 'open http://10.0.1.' || CAST(event_id % 5 AS STRING) || '/a' || CAST(event_id % 3 AS STRING) || '@b.io/home/x, then 10.0.1.2@c.io'
    WHEN 8 THEN '---' || chr(10) || 'title: t' || chr(10) || 'sensitivity: ' || CASE WHEN event_id % 4 = 0 THEN 'secret' ELSE 'private' END || chr(10) || '---' || chr(10) || 'ask user' || CAST(event_id % 5 AS STRING) || '@example.com'
    WHEN 9 THEN 'use sk-abcdefghijklmnopqrst' || CAST(event_id AS STRING) || ' for the call'
    WHEN 10 THEN 'Grüße ☕ an user' || CAST(event_id % 5 AS STRING) || '@example.com, Datei /home/jörg/ü.txt — fertig'
    WHEN 11 THEN NULL
    WHEN 12 THEN 'typed EMAIL_1 by hand, PATH_7 and EMAIL_10002, not xURL_1, with user' || CAST(event_id % 7 AS STRING) || '@example.com'
    ELSE 'the salary of my sister and my lawyer, from user' || CAST(event_id % 7 AS STRING) || '@example.com' END AS text
FROM events
UNION ALL
SELECT event_id * 2 + 1, {_S}, event_id, 'again other' || CAST(event_id % 13 AS STRING) || '@example.net and /tmp/again' || CAST(event_id % 4 AS STRING) FROM events WHERE event_id % 50 IN (3, 14, 28)"""
REPLIES = """SELECT rid, session_id, seq, CASE WHEN seq % 31 = 0 THEN NULL ELSE 'sent to EMAIL_' || CAST(seq % 13 + 1 AS STRING) || ' and PATH_' || CAST(seq % 40 + 1 AS STRING) END ||
  CASE CAST(seq % 8 AS INT)
    WHEN 0 THEN ' plus leak' || CAST(seq % 3 AS STRING) || '@corp.io'
    WHEN 1 THEN ' see https://h.example.org/x and URL_2'
    WHEN 2 THEN ' — Größe ☕ box 10.1.2.' || CAST(seq % 9 AS STRING) || ' of ORG_1'
    WHEN 3 THEN ' at /tmp/EMAIL_99/x, not xIP_1'
    ELSE ' only' END AS text
FROM prompts"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt to all cores if it is small."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PROMPTS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REPLIES.replace("FROM prompts", "FROM {prompts}"), prompts=prompts(spark, sf_dir))
