from pyspark.sql import functions as F

from framevitals.sources.scratch import fresh_path
from llm.warc import read_archives, resolve_revisits, write_archives


def warc(spark, sf_dir):
    """Write every page to deduplicated archives, read them back and resolve the revisits."""
    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = resolve_revisits(read_archives(spark, path, payloads=False))
    size = F.coalesce("original_bytes", "payload_bytes").alias("payload_bytes")
    return found.select("page_id", size, "payload_digest", "record_type", "refers_to", "digest_ok")


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC_SQL = f"""
with p as (
  select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), d as (
  select page_id, payload_bytes, hex, array_to_string(list_transform(range(32), lambda i:
    substr('{LETTERS}', 1 + ((
      list_reduce(list_transform(range(5), lambda j: cast(instr('0123456789abcdef', substr(hex, cast(5 * (i // 4) + j + 1 as bigint), 1)) - 1 as bigint)),
                  lambda a, b: a * 16 + b)
      >> cast(15 - 5 * (i % 4) as bigint)) & 31), 1)), '') as payload_digest
  from p
), f as (select hex, min(page_id) as first from p group by hex)
select page_id, payload_bytes, payload_digest,
       case when f.first is not null and page_id is distinct from f.first then 'revisit' else 'response' end as record_type,
       case when f.first is not null and page_id is distinct from f.first then f.first end as refers_to,
       case when f.first is not null and page_id is distinct from f.first then null else true end as digest_ok
from d join f using (hex)
"""

QUERIES = {"op2_warc": warc}
ORACLE = {"op2_warc": WARC_SQL}
