"""SQL for another engine with the same rows as the queries, written from the
definitions: plain window functions and joins that compare ranges directly."""

from __future__ import annotations

LOG = """write_log AS (
  SELECT *, (sum(length) OVER (PARTITION BY cli_id ORDER BY seq) - length)::BIGINT AS log_pos FROM (
    SELECT event_id AS seq, (user_id % 10)::INT AS gfid, (user_id % 4)::INT AS svr_rank, 1 AS app_id, user_id::INT AS cli_id,
      CASE WHEN s THEN rn * 64 ELSE (event_id * 7919) % 8192 END AS file_pos,
      CASE WHEN s THEN 64 ELSE 1 + (event_id * 104729) % 256 END AS length
    FROM (SELECT event_id, user_id, event_type IN ('view', 'click') AS s,
            row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events)))"""

PIECES = """points AS (SELECT gfid, file_pos AS p FROM {log} UNION SELECT gfid, file_pos + length FROM {log}),
steps AS (SELECT gfid, p AS a, lead(p) OVER (PARTITION BY gfid ORDER BY p) - 1 AS b FROM points),
pieces AS (
  SELECT s.gfid, s.a, s.b, w.seq, w.svr_rank, w.cli_id, w.log_pos + s.a - w.file_pos AS log_pos
  FROM steps s JOIN {log} w ON w.gfid = s.gfid AND w.file_pos <= s.a AND s.b <= w.file_pos + w.length - 1
  WHERE s.b IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY s.gfid, s.a ORDER BY w.seq DESC) = 1)"""

RUNS = """{name} AS (
  SELECT gfid, min(a) AS start, max(b) AS "end", {first}, min_by(log_pos, a) AS log_pos FROM (
    SELECT *, sum(cut) OVER (PARTITION BY gfid ORDER BY a) AS run FROM (
      SELECT *, CASE WHEN lag(b) OVER w = a - 1 AND lag(log_pos + b - a + 1) OVER w = log_pos {same} THEN 0 ELSE 1 END AS cut
      FROM pieces WINDOW w AS (PARTITION BY gfid ORDER BY a)))
  GROUP BY gfid, run)"""


def runs(name: str, same: list[str], first: list[str]) -> str:
    equal = " ".join(f"AND lag({c}) OVER w = {c}" for c in same)
    return RUNS.format(name=name, same=equal, first=", ".join(f"min_by({c}, a) AS {c}" for c in first))


EXTENTS = ",\n".join([LOG, PIECES.format(log="write_log"), runs("extents", ["svr_rank", "cli_id"], ["svr_rank", "cli_id"])])
REQUESTS = """reqs AS (
  SELECT event_id AS req_id, (user_id % 10)::INT AS gfid, user_id::INT AS cli_id, (event_id * 31) % 8192 AS "offset",
    1 + event_id % 512 AS length FROM events WHERE event_id % 50 = 0)"""
CHUNKS = """chunks AS (
  SELECT r.req_id, r.gfid, greatest(e.start, r."offset") AS "offset",
    least(e."end", r."offset" + r.length - 1) - greatest(e.start, r."offset") + 1 AS length,
    e.log_pos + greatest(e.start, r."offset") - e.start AS log_offset, e.svr_rank, 1 AS app_id, e.cli_id
  FROM reqs r JOIN extents e ON e.gfid = r.gfid AND e.start <= r."offset" + r.length - 1 AND r."offset" <= e."end")"""
READS = ",\n".join([EXTENTS, REQUESTS, CHUNKS])
FILES = """files AS (
  SELECT page_id, '/work/' || url AS filename, (('0x' || substr(md5('/work/' || url), 1, 8))::BIGINT >> 1)::INT AS gfid,
    strlen(html)::BIGINT AS size, (CASE WHEN page_id % 3 = 0 THEN 292 ELSE 420 END)::INT AS mode,
    page_id % 5 <> 0 AS is_shared, page_id % 3 = 0 AS is_laminated FROM pages)"""
OPS = """ops AS (
  SELECT event_id AS seq, (user_id % 10)::INT AS gfid,
    CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'view' THEN 'UTIME' WHEN 'click' THEN 'DATA' WHEN 'purchase' THEN 'CHMOD'
      WHEN 'error' THEN 'TRUNCATE' ELSE 'LAMINATE' END AS op,
    CASE WHEN event_id % 7 <> 0 THEN event_id * 17 % 512 END AS mode, CASE WHEN event_id % 3 <> 0 THEN event_id * 31 % 65536 END AS size,
    CASE WHEN event_id % 5 <> 0 THEN event_id * 1000 END AS mtime, CASE WHEN event_id % 11 <> 0 THEN event_id % 1000 END AS uid
  FROM events)"""
DOC_READS = """docs AS (SELECT doc_id AS gfid, strlen(text) AS n, encode(text) AS data, doc_id % 90 + 50 AS o, doc_id % 400 + 200 AS l FROM documents)"""


BATCHES = """r AS (
  SELECT event_id // 8 AS batch, event_id % 8 AS pos, (event_id * 13 % 12)::INT AS gfid, event_id * 7919 % 4000 AS "offset", event_id * 104729 % 600 AS nbytes,
    ['READ', 'WRITE', 'ZERO', 'READ', 'SYNC_META', 'WRITE', 'SYNC_DATA', 'NOP', 'WRITE', 'READ', 'BAD', 'TRUNC'][1 + CASE WHEN event_id % 97 = 0 THEN 10 WHEN event_id % 23 = 0 THEN 11 ELSE event_id * 31 % 10 END] AS op FROM events),
h AS (SELECT *, CASE op WHEN 'READ' THEN 1 WHEN 'WRITE' THEN 2 WHEN 'ZERO' THEN 2 WHEN 'TRUNC' THEN 3 WHEN 'SYNC_META' THEN 4 WHEN 'SYNC_DATA' THEN 4 END AS phase,
  count(*) FILTER (op = 'BAD') OVER (PARTITION BY batch) > 0 AS bad FROM r),
p AS (SELECT *, (CASE WHEN phase IS NOT NULL AND NOT bad THEN row_number() OVER (PARTITION BY batch ORDER BY phase NULLS LAST, pos) END)::INT AS turn FROM h),
good AS (SELECT * FROM p WHERE turn IS NOT NULL), f AS (SELECT range::INT AS gfid, range * 100 AS size FROM range(10))"""


def _fold(field: str, kinds: str) -> str:
    return f"max_by({field}, CASE WHEN op IN ({kinds}) AND {field} IS NOT NULL THEN seq END) AS {field}"


_NUM = "CASE WHEN isnan({0}) THEN 'nan' WHEN {0} = 'inf'::DOUBLE THEN 'inf' WHEN {0} = '-inf'::DOUBLE THEN '-inf' ELSE round({0}, 6)::DECIMAL(30,6)::VARCHAR END"

SQL: dict[str, str] = {
    "extent_overlay": f"""WITH {LOG},\n{PIECES.format(log="write_log")},\n{runs("runs", ["seq"], ["seq", "svr_rank", "cli_id"])}
SELECT gfid, start, "end", seq, svr_rank, cli_id, log_pos FROM runs""",
    "extent_coalesce": f'WITH {EXTENTS} SELECT gfid, start, "end", svr_rank, cli_id, log_pos FROM extents',
    "extent_coalesce_any_client": f"""WITH {LOG}, mine AS (SELECT * REPLACE (cli_id AS gfid) FROM write_log),
{PIECES.format(log="mine")},\n{runs("runs", ["svr_rank"], ["svr_rank"])} SELECT gfid, start, "end", log_pos FROM runs""",
    "extent_find": f"""WITH {EXTENTS},\n{REQUESTS}
SELECT req_id, gfid, lo, hi, start, "end", log_pos FROM (
  SELECT r.req_id, r.gfid, r."offset" AS lo, r."offset" + r.length - 1 AS hi, e.start, e."end", e.log_pos
  FROM reqs r LEFT JOIN extents e ON e.gfid = r.gfid AND e.start <= r."offset" + r.length - 1 AND r."offset" <= e."end")
QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY start) = 1""",
    "extent_truncate": f"""WITH {EXTENTS}, sizes AS (SELECT range::INT AS gfid, range * 1000 AS size FROM range(5))
SELECT e.gfid, start, CASE WHEN size IS NULL THEN "end" ELSE least("end", size - 1) END AS "end", cli_id, log_pos
FROM extents e LEFT JOIN sizes USING (gfid) WHERE size IS NULL OR start < size""",
    "extent_remove_range": f"""WITH {EXTENTS}, cut AS (SELECT (range % 7)::INT AS gfid, range * 300 + 33 AS lo, range * 300 + 777 - range % 3 * 500 AS hi FROM range(21)),
pts AS (SELECT gfid, start AS p FROM extents UNION SELECT gfid, "end" + 1 FROM extents UNION SELECT gfid, lo FROM cut UNION SELECT gfid, hi + 1 FROM cut),
cuts AS (SELECT gfid, p AS a, lead(p) OVER (PARTITION BY gfid ORDER BY p) - 1 AS b FROM pts),
left_over AS (
  SELECT s.gfid, s.a, s.b, e.start AS ext, e.cli_id, e.log_pos + s.a - e.start AS log_pos
  FROM cuts s JOIN extents e ON e.gfid = s.gfid AND e.start <= s.a AND s.b <= e."end"
  WHERE s.b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cut c WHERE c.gfid = s.gfid AND c.lo <= s.a AND s.b <= c.hi)),
{runs("rest", ["ext"], ["cli_id"]).replace("FROM pieces", "FROM left_over")}
SELECT gfid, start, "end", cli_id, log_pos FROM rest""",
    "extent_stats": f"""WITH {EXTENTS} SELECT gfid, count(*) AS n_extents, sum("end" - start + 1)::BIGINT AS n_bytes, max("end") AS max_offset
FROM extents GROUP BY gfid""",
    "extent_in_order": f'WITH {EXTENTS} SELECT gfid, start, "end", lead(start) OVER (PARTITION BY gfid ORDER BY start) AS next_start FROM extents',
    "extent_first_free": f"""WITH {REQUESTS}, r AS (
  SELECT req_id, "offset" AS s1, "offset" + length - 1 AS e1, req_id * 37 % 8192 AS s2, req_id * 37 % 8192 + req_id % 700 AS e2 FROM reqs)
SELECT req_id, (CASE WHEN e1 < s2 THEN -1 WHEN s1 > e2 THEN 1 ELSE 0 END)::INT AS "order",
  CASE WHEN s1 <= e2 AND s2 <= e1 THEN CASE WHEN s1 < s2 THEN s1 WHEN e1 > e2 THEN e2 + 1 END END AS free_start,
  CASE WHEN s1 <= e2 AND s2 <= e1 THEN CASE WHEN s1 < s2 THEN s2 - 1 WHEN e1 > e2 THEN e1 END END AS free_end FROM r""",
    "extent_index_flatten": f"""WITH {EXTENTS} SELECT gfid, start AS file_pos, log_pos, "end" - start + 1 AS length FROM extents""",
    "slice_counts": f"""WITH {LOG} SELECT gfid, sum((file_pos + length - 1) // 1024 - file_pos // 1024 + 1)::BIGINT AS n_slices, count(*) AS n_writes
FROM write_log GROUP BY gfid""",
    "chunk_plan": f"WITH {READS} SELECT * FROM chunks",
    "read_coverage": f"""WITH {READS}, got AS (
  SELECT req_id, count(*) AS n, sum(length)::BIGINT AS b, min("offset") AS f, max("offset" + length - 1) AS l FROM chunks GROUP BY 1)
SELECT r.req_id, gfid, coalesce(n, 0) AS n_chunks, coalesce(b, 0) AS n_bytes, f - "offset" AS "begin", coalesce(l + 1 - "offset", 0) AS nread,
  coalesce(b, 0) = length AS covered FROM reqs r LEFT JOIN got USING (req_id)""",
    "server_fanout": f"WITH {READS} SELECT req_id, svr_rank, count(*) AS n_chunks, sum(length)::BIGINT AS n_bytes FROM chunks GROUP BY ALL",
    "read_submit": f"""WITH {EXTENTS}, base AS (SELECT * FROM (WITH {REQUESTS} SELECT * FROM reqs)),
reqs AS (SELECT * REPLACE (CASE WHEN req_id % 300 = 0 THEN 1000000000 ELSE "offset" END AS "offset") FROM base),
{CHUNKS}, got AS (SELECT req_id, count(DISTINCT svr_rank) AS s, count(*) AS n, sum(length)::BIGINT AS b FROM chunks GROUP BY 1)
SELECT req_id, gfid, coalesce(s, 0) AS n_servers, coalesce(n, 0) AS n_chunks, coalesce(b, 0) AS n_bytes,
  CASE WHEN n IS NULL THEN 'ENODATA' ELSE 'OK' END AS rc FROM reqs LEFT JOIN got USING (req_id)""",
    "local_vs_forwarded": f"""WITH {READS} SELECT r.req_id, r.gfid, r.cli_id, coalesce(sum(c.length), 0) = r.length AS "local"
FROM reqs r LEFT JOIN chunks c ON c.req_id = r.req_id AND c.cli_id = r.cli_id GROUP BY r.req_id, r.gfid, r.cli_id, r.length""",
    "extent_locate": f"""WITH {READS}, l AS (
  SELECT r.req_id, r.gfid, r.cli_id, coalesce(sum(c.length), 0) = r.length AS loc
  FROM reqs r LEFT JOIN chunks c ON c.req_id = r.req_id AND c.cli_id = r.cli_id GROUP BY r.req_id, r.gfid, r.cli_id, r.length)
SELECT req_id, CASE WHEN gfid % 4 = cli_id % 4 THEN 'owner' WHEN gfid % 3 = 0 AND gfid % 2 = 0 THEN 'laminated' WHEN loc THEN 'local' ELSE 'remote' END AS source FROM l""",
    "response_split": f"""WITH {READS}, s AS (SELECT *, unnest(range(0, length, 100)) AS x FROM chunks)
SELECT req_id, gfid, "offset" + x AS "offset", least(100, length - x) AS length FROM s""",
    "read_complete": f"""WITH {READS}, p AS (SELECT req_id, svr_rank, count(*) AS n, sum(length) AS b FROM chunks GROUP BY ALL)
SELECT req_id, bool_and(b % 7 <> 0) AS complete, count(*) AS n_servers, min(-(n % 2)) AS rc FROM p GROUP BY 1""",
    "hole_fill_eof": f"""WITH {DOC_READS}, b AS (SELECT *, greatest(0, least(l, n + 100 - o)) AS nread,
    repeat('00', 100)::VARCHAR || hex(data) AS h FROM docs)
SELECT gfid AS req_id, nread::BIGINT AS nread, md5(unhex(substr(h, (2 * o + 1)::BIGINT, (2 * nread)::BIGINT))) AS md5 FROM b""",
    "chunk_serve": f"""WITH {DOC_READS}, b AS (SELECT *, greatest(o, 100) AS f, least(o + l, n + 100) AS t, hex(data) AS h FROM docs)
SELECT gfid AS req_id, f AS "offset", t - f AS read_rc, md5(unhex(substr(h, (2 * (f - 100) + 1)::BIGINT, (2 * (t - f))::BIGINT))) AS md5 FROM b WHERE t > f""",
    "read_order": f'WITH {REQUESTS} SELECT req_id, gfid, "offset" FROM reqs',
    "file_gfid_owner": f"WITH {FILES} SELECT filename, gfid, (gfid % 4)::INT AS owner FROM files",
    "file_create": """SELECT event_id AS seq, '/work/u' || user_id AS path,
  CASE WHEN user_id % 10 <> 0 AND row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'OK' ELSE 'EEXIST' END AS rc FROM events""",
    "attr_fold": f"""WITH {OPS} SELECT gfid, {_fold("mode", "'CREATE', 'CHMOD', 'LAMINATE'")},
  {_fold("size", "'CREATE', 'DATA', 'TRUNCATE', 'LAMINATE'")}, {_fold("mtime", "'CREATE', 'UTIME', 'DATA', 'TRUNCATE', 'LAMINATE'")},
  {_fold("uid", "'CREATE', 'CHOWN'")} FROM ops GROUP BY gfid""",
    "meta_dispatch": f"""WITH {OPS}, t AS (
  SELECT op, gfid < 6 OR coalesce(max(op = 'CREATE') OVER (PARTITION BY gfid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS there FROM ops)
SELECT op, CASE WHEN op = 'CREATE' THEN CASE WHEN there THEN 'EEXIST' ELSE 'OK' END WHEN there THEN 'OK' ELSE 'ENOENT' END AS rc, count(*) AS n FROM t GROUP BY ALL""",
    "meta_lookup": f"""WITH {FILES}, r AS (SELECT page_id AS req_id, gfid + CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END AS gfid FROM files)
SELECT req_id, CASE WHEN f.gfid IS NULL THEN 'ENOENT' ELSE 'OK' END AS rc, f.size FROM r LEFT JOIN files f ON f.gfid = r.gfid""",
    "meta_source": f"""WITH {FILES} SELECT page_id, CASE WHEN gfid % 4 = 1 THEN 'owner' WHEN is_laminated THEN 'laminated'
    WHEN page_id * 37 % 9000 <= 5000 THEN 'cache' ELSE 'remote' END AS attr_source,
  CASE WHEN gfid % 4 = 1 THEN 'owner' WHEN is_laminated THEN 'laminated' ELSE 'remote' END AS size_source FROM files""",
    "file_size": f"""WITH {EXTENTS}, k AS (SELECT range::INT AS gfid, range * 3000 AS size FROM range(12))
SELECT k.gfid, greatest(k.size, coalesce(max(e."end") + 1, 0))::BIGINT AS size FROM k LEFT JOIN extents e USING (gfid) GROUP BY k.gfid, k.size""",
    "stat_projection": f"""WITH {FILES} SELECT gfid AS st_ino, filename, size AS st_size, ((size + 4095) // 4096)::BIGINT AS st_blocks,
  (CASE WHEN is_laminated THEN 1 ELSE 0 END)::INT AS st_nlink, mode AS st_mode FROM files""",
    "laminate_rule": f"""WITH {FILES}, c AS (SELECT *, (CASE WHEN page_id % 2 = 0 THEN CASE WHEN page_id % 4 = 0 THEN 292 ELSE 384 END END)::INT AS m FROM files)
SELECT page_id, coalesce(m, mode) AS mode, is_laminated OR coalesce((mode & 146) <> 0 AND (mode & 146 & m) = 0, false) AS is_laminated FROM c""",
    "laminate_extents": f"""WITH {EXTENTS} SELECT gfid, start, "end", cli_id, log_pos FROM extents WHERE gfid % 3 = 0 AND gfid % 2 = 0""",
    "mode_masking": f"""WITH {OPS} SELECT seq, ((CASE WHEN coalesce(mode, 0) = 0 THEN 438 ELSE mode END) & 511 & ~18)::INT AS mode FROM ops""",
    "namespace_filter": """SELECT page_id, p AS path FROM (
  SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/work/' ELSE '/worker/' END || url AS p FROM pages) WHERE p = '/work' OR starts_with(p, '/work/')""",
    "path_normalize": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/a/' ELSE '/work/a/' END || page_id AS path FROM pages",
    "global_listing": f"""WITH {FILES} SELECT filename, CASE WHEN mode = 292 THEN '444' ELSE '644' END AS mode, size, gfid FROM files
QUALIFY row_number() OVER (PARTITION BY filename ORDER BY gfid) = 1""",
    "owned_files": f"WITH {FILES} SELECT gfid, filename, size FROM files WHERE gfid % 4 = 2",
    "dir_empty": """WITH f AS (SELECT DISTINCT '/work/' || (user_id % 20) AS p FROM events)
SELECT '/work/' || range AS path, '/work/' || range NOT IN (SELECT p FROM f) AS is_empty FROM range(30)""",
    "unlink_live_files": f"WITH {EXTENTS} SELECT gfid, count(*) AS n_extents FROM extents WHERE gfid % 4 <> 0 GROUP BY 1",
    "unlink_callbacks": f"WITH {EXTENTS} SELECT DISTINCT gfid, svr_rank, 1 AS app_id, cli_id FROM extents WHERE gfid % 4 = 0",
    "rename_files": f"""WITH {FILES} SELECT gfid, '/f' || CASE page_id % 10 WHEN 0 THEN page_id + 2 WHEN 5 THEN page_id + 1 WHEN 6 THEN CASE WHEN page_id - 1 IN (SELECT page_id FROM pages) THEN page_id - 1 ELSE page_id END ELSE page_id END AS filename
FROM files WHERE NOT (page_id % 10 IN (1, 2) AND page_id // 10 * 10 IN (SELECT page_id FROM pages))""",
    "pending_sync_batch": f"""WITH {LOG} SELECT gfid, count(*) AS n_syncs, sum(length % 9 + 1)::BIGINT AS n_extents, min(seq) AS first_seq, max(seq) AS last_seq,
  count(DISTINCT cli_id) AS n_clients, ((sum(length % 9 + 1) + 499) // 500)::BIGINT AS n_messages FROM write_log GROUP BY gfid""",
    "metaget_dedup": f"""WITH {REQUESTS} SELECT req_id AS seq, gfid, min(req_id) OVER (PARTITION BY gfid) AS leader,
  req_id = min(req_id) OVER (PARTITION BY gfid) AS sent FROM reqs""",
    "reverse_lookup": f"""WITH {FILES}, q AS (SELECT page_id AS req_id, gfid + CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END AS gfid FROM files)
SELECT q.req_id, q.gfid, f.page_id AS fid, f.filename FROM q LEFT JOIN files f USING (gfid)""",
    "log_offsets": f"WITH {LOG} SELECT seq, cli_id, log_pos FROM write_log",
    "log_sizes": f"""WITH {LOG} SELECT svr_rank, app_id, cli_id, sum(length)::BIGINT AS n_bytes, max(log_pos + length) AS "end",
  ((max(log_pos + length) + 4095) // 4096)::BIGINT AS n_chunks FROM write_log GROUP BY ALL""",
    "memory_spill_split": f"""WITH {LOG} SELECT seq, greatest(0, least(length, 4000 - log_pos)) AS mem, least(length, greatest(0, log_pos + length - 4000)) AS spill,
  CASE WHEN log_pos + length <= 4000 THEN -1 ELSE greatest(0, log_pos - 4000) END AS spill_off FROM write_log""",
    "chunk_counts": f"WITH {LOG} SELECT seq, ((length + 99) // 100)::BIGINT AS n_chunks FROM write_log",
    "zero_runs": """WITH b AS (SELECT range AS byte FROM range(256)), s AS (SELECT range AS s FROM range(8)), n AS (SELECT range + 1 AS n FROM range(8)),
r AS (SELECT byte, s, n FROM b, s, n WHERE s + n <= 8 AND (byte >> s) & ((1 << n) - 1) = 0)
SELECT b.byte, coalesce(max(n), 0)::INT AS length, arg_min(s, -n * 10 + s)::INT AS start FROM b LEFT JOIN r USING (byte) GROUP BY 1""",
    "dispatch_phases": """WITH r AS (SELECT event_id // 8 AS batch, event_id % 8 AS pos,
    ['READ', 'WRITE', 'ZERO', 'TRUNC', 'SYNC_META', 'SYNC_DATA', 'NOP', 'BAD'][1 + CASE WHEN event_id % 97 = 0 THEN 7 ELSE event_id * 31 % 7 END] AS op FROM events),
p AS (SELECT *, CASE op WHEN 'READ' THEN 1 WHEN 'WRITE' THEN 2 WHEN 'ZERO' THEN 2 WHEN 'TRUNC' THEN 3 WHEN 'SYNC_META' THEN 4 WHEN 'SYNC_DATA' THEN 4 END AS phase,
  count(*) FILTER (op = 'BAD') OVER (PARTITION BY batch) > 0 AS bad FROM r)
SELECT batch, pos, op, phase::INT AS phase, CASE WHEN bad THEN 'EINVAL' ELSE 'OK' END AS rc,
  (CASE WHEN phase IS NOT NULL AND NOT bad THEN row_number() OVER (PARTITION BY batch ORDER BY phase NULLS LAST, pos) END)::INT AS turn FROM p""",
    "sync_epochs": f"""WITH {LOG} SELECT seq, CASE WHEN seq % 5 = 0 THEN 'SYNC' ELSE 'WRITE' END AS op,
  min(CASE WHEN seq % 5 = 0 THEN seq END) OVER (PARTITION BY cli_id, gfid ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS epoch FROM write_log""",
    "batch_wait": """SELECT event_id // 4 AS batch, bool_and(event_id * 13 % 10 < 7) AS all_done, bool_or(event_id * 13 % 10 < 7) AS any_done, count(*) AS n
FROM events GROUP BY 1""",
    "transfer_validate": """SELECT page_id, CASE WHEN (page_id % 2 = 0) = (page_id % 3 = 0) THEN 'EINVAL' WHEN page_id % 3 = 0 THEN 'ENOSYS' ELSE 'OK' END AS rc FROM pages""",
    "transfer_plan": f"""WITH {EXTENTS} SELECT gfid, svr_rank, count(*) AS n_extents, sum("end" - start + 1)::BIGINT AS n_bytes, max("end") AS last
FROM extents GROUP BY ALL""",
    "transfer_batches": f"""WITH RECURSIVE {EXTENTS}, e AS (
  SELECT gfid, svr_rank, start, "end", row_number() OVER (PARTITION BY gfid, svr_rank ORDER BY start) AS i FROM extents),
f AS (
  SELECT gfid, svr_rank, start, "end", i, 0::BIGINT AS batch, 0::BIGINT AS "at" FROM e WHERE i = 1
  UNION ALL SELECT e.gfid, e.svr_rank, e.start, e."end", e.i,
    CASE WHEN f."at" + f."end" - f.start + 1 + e."end" - e.start + 1 > 1000 THEN f.batch + 1 ELSE f.batch END,
    CASE WHEN f."at" + f."end" - f.start + 1 + e."end" - e.start + 1 > 1000 THEN 0 ELSE f."at" + f."end" - f.start + 1 END
  FROM f JOIN e ON e.gfid = f.gfid AND e.svr_rank = f.svr_rank AND e.i = f.i + 1)
SELECT gfid, svr_rank, start, "end", batch, "at" FROM f""",
    "transfer_partition": """WITH c AS (SELECT doc_id AS gfid, n_chars AS size, (n_chars + 99) // 100 AS n FROM documents),
r AS (SELECT *, unnest([0, 1, 2, 3])::INT AS rank FROM c),
p AS (SELECT gfid, rank, size, CASE WHEN n <= 4 THEN 0 ELSE rank * (n // 4) + least(rank, n % 4) END AS f,
  CASE WHEN n <= 4 THEN CASE WHEN rank = 0 THEN n ELSE 0 END ELSE n // 4 + CASE WHEN rank < n % 4 THEN 1 ELSE 0 END END AS k FROM r)
SELECT gfid, rank, f::BIGINT AS first_chunk, k::BIGINT AS n_chunks, (f * 100)::BIGINT AS "offset", (least((f + k) * 100, size) - f * 100)::BIGINT AS n_bytes FROM p WHERE k > 0""",
    "stage_blocks": """WITH c AS (SELECT doc_id AS gfid, n_chars AS size, (n_chars + 63) // 64 AS n FROM documents),
r AS (SELECT *, greatest(8, (n + 2) // 3) AS per, unnest([0, 1, 2])::INT AS rank FROM c)
SELECT gfid, rank, (rank * per * 64)::BIGINT AS "offset", (least((rank + 1) * per * 64, size) - rank * per * 64)::BIGINT AS n_bytes FROM r WHERE rank * per < n""",
    "stage_manifest": """SELECT page_id AS line_no, CASE WHEN page_id % 6 = 2 THEN '/a' WHEN page_id % 6 = 3 THEN '/a b' END AS src,
  CASE WHEN page_id % 6 IN (2, 3) THEN url END AS dst, CASE WHEN page_id % 6 IN (2, 3) THEN 'OK' ELSE 'EINVAL' END AS rc
FROM pages WHERE page_id % 6 > 1""",
    "transfer_managers": "SELECT page_id, (page_id % 6)::INT AS manager FROM pages",
    "checksum_verify": """SELECT doc_id AS gfid, md5(text) AS src_md5,
  CASE WHEN doc_id % 11 <> 5 THEN md5(CASE WHEN doc_id % 10 = 3 THEN 'x' ELSE text END) END AS dst_md5,
  doc_id % 11 <> 5 AND (doc_id % 10 <> 3 OR text = 'x') AS same FROM documents""",
    "bcast_tree": """WITH n AS (SELECT count(*) AS n FROM supplier), s AS (SELECT s_suppkey::INT AS rank, (s_suppkey - 5 + n) % n AS p, n FROM supplier, n)
SELECT rank, (CASE WHEN p > 0 THEN ((p - 1) // 2 + 5) % n END)::INT AS parent,
  array_to_string(list_transform(list_filter([2 * p + 1, 2 * p + 2], lambda c: c < n), lambda c: (c + 5) % n), ',') AS children,
  len(list_filter([2 * p + 1, 2 * p + 2], lambda c: c < n))::INT AS n_children, floor(log2(p + 1))::INT AS depth FROM s""",
    "collective_result": """WITH c AS (SELECT event_id // 8 AS op_id, event_id % 8 AS rank, CASE WHEN event_id * 29 % 31 < 2 THEN -(event_id % 40) ELSE 0 END AS rc FROM events)
SELECT op_id, coalesce(min_by(rc, rank) FILTER (rc <> 0), 0)::INT AS rc, count(*) AS n_servers, count(*) FILTER (rc <> 0) AS n_failed FROM c GROUP BY 1""",
    "key_values": """SELECT event_type AS scope, user_id AS key, max_by(props, event_id) AS value, max(event_id) AS seq FROM events GROUP BY ALL""",
    "host_order": """SELECT s_suppkey AS rank, s_nationkey AS host, count(*) OVER (PARTITION BY s_nationkey) AS n_on_host,
  min(s_suppkey) OVER (PARTITION BY s_nationkey) AS first_on_host FROM supplier""",
    "distinct_callbacks": f"WITH {LOG} SELECT DISTINCT gfid, app_id, cli_id FROM write_log",
    "heartbeat_state": """SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'gone' WHEN 10000000 - max(event_id) * 1000 > 30000 THEN 'probe' ELSE 'ok' END AS state
FROM events GROUP BY 1""",
    "config_functions": f"""WITH t AS (SELECT s_suppkey, (s_suppkey % 40 - 3)::DOUBLE AS x, ((s_suppkey % 40 - 3) % 5)::DOUBLE AS y FROM supplier),
v AS (SELECT s_suppkey,
  CASE WHEN x > 0 THEN ln(x) WHEN x = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS a,
  CASE WHEN x > 0 THEN log10(x) WHEN x = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS b,
  CASE WHEN y <> 0 THEN x / y WHEN x = 0 THEN 'nan'::DOUBLE ELSE sign(x) * 'inf'::DOUBLE END AS c,
  CASE WHEN y <> 0 THEN fmod(x, y) ELSE 'nan'::DOUBLE END AS d,
  CASE WHEN y < 0 THEN 'nan'::DOUBLE ELSE factorial(y::INT)::DOUBLE END AS e,
  CASE WHEN x < 0 OR y < 0 OR x < y THEN 'nan'::DOUBLE ELSE coalesce(list_product(list_transform(range(0, y::BIGINT), lambda i: x - i)), 1) / factorial(y::INT) END AS f,
  atan2(x, y + 1) AS g, floor(x / 3) AS h, ceil(x / 3) AS i FROM t WHERE x < 30 OR true)
SELECT s_suppkey, {_NUM.format("a")} AS ln, {_NUM.format("b")} AS log, {_NUM.format("c")} AS quotient, {_NUM.format("d")} AS remainder,
  {_NUM.format("e")} AS factorial, {_NUM.format("f")} AS ncr, {_NUM.format("g")} AS atan2, {_NUM.format("h")} AS floor, {_NUM.format("i")} AS ceil FROM v""",
    "config_resolve": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'cli' || p_partkey WHEN p_partkey % 3 = 0 THEN 'env' || p_partkey
    WHEN p_partkey % 5 = 0 THEN 'file' || p_partkey ELSE 'default' END AS value,
  CASE WHEN p_partkey % 2 = 0 THEN 'cli' WHEN p_partkey % 3 = 0 THEN 'env' WHEN p_partkey % 5 = 0 THEN 'file' ELSE 'default' END AS source FROM part""",
    "config_numbers": """SELECT p_partkey, p_partkey * CASE p_partkey % 3 WHEN 0 THEN 1024 WHEN 1 THEN 1 ELSE 10 END AS value,
  p_partkey % 3 = 0 AS is_expression, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag FROM part""",
    "stream_modes": """WITH m AS (SELECT p_partkey, ['r', 'w', 'a', 'r+', 'w+b', 'ab', 'x', 'rw'][1 + p_partkey % 8] AS mode FROM part),
v AS (SELECT *, mode NOT IN ('x', 'rw') AS ok, contains(mode, '+') AS plus, mode[1] AS l FROM m)
SELECT p_partkey, mode, CASE WHEN ok THEN l = 'r' OR plus END AS read, CASE WHEN ok THEN l <> 'r' OR plus END AS write, CASE WHEN ok THEN l <> 'r' END AS "create",
  CASE WHEN ok THEN l = 'w' END AS "truncate", CASE WHEN ok THEN l = 'a' END AS append FROM v""",
    "range_guard": "SELECT p_partkey, 9223372036854775000::HUGEINT + p_partkey > 9223372036854775807 AS overflows FROM part",
    "workload_n1": """SELECT r.range::INT AS rank, b.range::INT AS block_no, c.range::INT AS chunk_no, 0 AS gfid,
  b.range * 1048576 * 4 + r.range * 1048576 + c.range * 65536 AS "offset", 65536::BIGINT AS length, (3 - r.range)::INT AS reader
FROM range(4) r, range(32) b, range(16) c""",
    "workload_nn": """SELECT r.range::INT AS rank, b.range::INT AS block_no, c.range::INT AS chunk_no, r.range::INT AS gfid,
  b.range * 1048576 + c.range * 300000 AS "offset", least(300000, 1048576 - c.range * 300000)::BIGINT AS length, (3 - r.range)::INT AS reader
FROM range(4) r, range(32) b, range(4) c""",
    "bandwidth_summary": f"""WITH {LOG}, t AS (SELECT gfid AS phase, cli_id, sum(length)::BIGINT AS b, count(*) / 8.0 AS s FROM write_log GROUP BY ALL)
SELECT phase, sum(b)::BIGINT AS n_bytes, round(sum(b / s::DOUBLE), 3) AS aggregate_rate, round(sum(b) / max(s)::DOUBLE, 3) AS effective_rate, count(*) AS n_ranks
FROM t GROUP BY 1""",
    "conflict_pairs": f"""WITH {LOG} SELECT a.gfid, count(*) FILTER (a.cli_id = b.cli_id) AS same_client, count(*) FILTER (a.cli_id <> b.cli_id) AS different_clients
FROM write_log a JOIN write_log b ON a.gfid = b.gfid AND a.seq < b.seq AND a.file_pos < b.file_pos + b.length AND b.file_pos < a.file_pos + a.length GROUP BY 1""",
    "list_io": """WITH r AS (SELECT event_id // 6 AS batch, event_id % 6 AS pos, CASE WHEN event_id % 5 = 0 THEN 'WRITE' WHEN event_id % 11 = 0 THEN 'NOP' ELSE 'READ' END AS op,
  (user_id % 12)::INT AS gfid, event_id * 31 % 9000 AS o, event_id % 512 AS n FROM events)
SELECT batch, pos, op, gfid, (CASE WHEN op = 'NOP' OR gfid >= 10 THEN NULL WHEN op = 'WRITE' THEN n ELSE greatest(0, least(n, gfid * 1000 - o)) END)::BIGINT AS ret,
  (CASE WHEN op <> 'NOP' THEN CASE WHEN gfid < 10 THEN 0 ELSE 22 END END)::INT AS err FROM r""",
    "path_exists": """WITH f AS (SELECT '/work/' || (user_id % 20) || '/' || event_id AS p FROM events),
q AS (SELECT event_id AS req_id, CASE WHEN event_id % 2 = 0 THEN '/work/' || (event_id % 40) ELSE '/work/' || (event_id % 20) || '/' || event_id END AS path FROM events),
known AS (SELECT p FROM f UNION SELECT regexp_extract(p, '^(.*)/[^/]*$', 1) FROM f)
SELECT req_id, path, CASE WHEN path IN (SELECT p FROM known) THEN 'OK' ELSE 'ENOENT' END AS rc FROM q""",
    "directory_changes": """WITH o AS (SELECT event_id AS seq, CASE WHEN event_id * 7 % 5 < 3 THEN 'MKDIR' ELSE 'RMDIR' END AS op, user_id % 40 AS n FROM events),
p AS (SELECT *, n < 12 AND n % 3 = 0 AS filled, lag(op) OVER (PARTITION BY n ORDER BY seq) AS before FROM o),
t AS (SELECT *, filled OR coalesce(before = 'MKDIR', n < 12) AS there FROM p)
SELECT seq, op, '/work/' || n AS path, CASE WHEN op = 'MKDIR' THEN CASE WHEN there THEN 'EEXIST' ELSE 'OK' END WHEN NOT there THEN 'ENOENT' WHEN filled THEN 'ENOTEMPTY' ELSE 'OK' END AS rc FROM t""",
    "file_holes": f"""WITH {EXTENTS}, k AS (SELECT range::INT AS gfid, range * 1000 AS size FROM range(12)),
e AS (SELECT gfid, start, "end" FROM extents WHERE gfid < 12 UNION ALL SELECT gfid, -1, -1 FROM k),
g AS (SELECT gfid, "end" + 1 AS start, lead(start) OVER (PARTITION BY gfid ORDER BY start) AS nxt FROM e)
SELECT g.gfid, start::BIGINT AS start, (least(coalesce(nxt, size), size) - 1)::BIGINT AS "end" FROM g JOIN k USING (gfid) WHERE start < least(coalesce(nxt, size), size)""",
    "node_local_chunks": f"""WITH {EXTENTS} SELECT gfid::BIGINT AS req_id, start AS "offset", "end" - start + 1 AS length, log_pos AS log_offset, svr_rank, cli_id
FROM extents""",
    "file_system_row": """SELECT 16914836::BIGINT AS f_type, 4194304::BIGINT AS f_bsize, 128::BIGINT AS f_files, count(*) AS f_used, 1024::BIGINT AS f_namelen FROM pages""",
    "formatted_scan": """WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, p_partkey AS n FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN n WHEN 1 THEN -n WHEN 3 THEN n END AS whole, CASE k WHEN 0 THEN n % 90 * 10 + 5 WHEN 3 THEN 70 END AS tenths,
  CASE k WHEN 0 THEN 'tail' WHEN 3 THEN substr(printf('%x', n), 1, 4) END AS word, (CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 3 THEN 3 ELSE 0 END)::INT AS n_fields FROM p""",
    "formatted_print": """SELECT p_partkey, p_name || ': ' || p_size AS text, strlen(p_name || ': ' || p_size)::BIGINT AS ret FROM part""",
    "line_reads": r"""WITH t AS (SELECT page_id AS gfid, regexp_replace(coalesce(html, ''), '[^\x0A\x20-\x7E]', '?', 'g') AS t FROM pages),
l AS (SELECT gfid, generate_subscripts(a, 1) - 1 AS line_no, unnest(a) AS line, len(a) AS n FROM (SELECT gfid, string_split(t, chr(10)) AS a FROM t)),
s AS (SELECT gfid, line_no, length(line) + CASE WHEN line_no < n - 1 THEN 1 ELSE 0 END AS c FROM l)
SELECT gfid, sum((c + 78) // 79)::BIGINT AS n_pieces, max(line_no)::BIGINT AS last_line, sum(c)::BIGINT AS n_chars FROM s WHERE c > 0 GROUP BY 1""",
    "typed_ranges": """SELECT p_partkey AS line_no, CASE WHEN p_partkey % 3 < 2 THEN p_partkey END AS "offset",
  CASE p_partkey % 3 WHEN 0 THEN p_partkey * 2 WHEN 1 THEN p_partkey END AS length FROM part WHERE p_partkey < 900""",
    "error_codes": """SELECT (1000 + row_number() OVER (ORDER BY name))::INT AS code, name, text FROM (VALUES
  ('BADCONFIG', 'Configuration has invalid setting'), ('GOTCHA', 'Gotcha operation error'), ('KEYVAL', 'Key-value store operation error'),
  ('MARGO', 'Mercury/Argobots operation error'), ('NYI', 'Not yet implemented'), ('PMI', 'PMI2/PMIx error'),
  ('SHMEM', 'Shared memory region init/access error'), ('THREAD', 'POSIX thread operation failed'), ('TIMEOUT', 'Timed out')) AS e(name, text)""",
    "small_operations": """WITH k AS (SELECT ['open', 'close', 'file stat', 'lseek', 'read', 'write', 'chdir', 'directory stat', 'statfs', 'readdir', 'mkdir', 'rmdir',
    'unlink', 'rename', 'creat', 'truncate', 'symlink', 'readlink', 'link to one file', 'link to a file per process', 'fcntl locking'] AS a),
n AS (SELECT generate_subscripts(a, 1) - 1 AS i, unnest(a) AS op FROM k)
SELECT r.range * 84 + n.i * 4 + c.range AS seq, c.range::INT AS rank, op, '/simul_' || replace(op, ' ', '_') || '.' || c.range AS path FROM n, range(3) r, range(4) c""",
    "conflict_kinds": f"""WITH {LOG}, a AS (
  SELECT seq, gfid, cli_id, CASE WHEN seq % 9 = 0 THEN 'SYNC' WHEN seq % 2 = 0 THEN 'READ' ELSE 'WRITE' END AS op, file_pos AS f, file_pos + length - 1 AS t FROM write_log),
s AS (SELECT *, min(CASE WHEN op = 'SYNC' THEN seq END) OVER (PARTITION BY gfid, cli_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sync FROM a)
SELECT x.gfid, y.op[1] || 'A' || x.op[1] AS kind, coalesce(x.sync < y.seq, false) AS synced, count(*) AS n_pairs
FROM s x JOIN s y ON x.gfid = y.gfid AND x.seq < y.seq AND x.cli_id <> y.cli_id AND x.f <= y.t AND y.f <= x.t
WHERE x.op <> 'SYNC' AND y.op <> 'SYNC' AND 'WRITE' IN (x.op, y.op) GROUP BY ALL""",
    "directory_reads": """WITH RECURSIVE o AS (
  SELECT user_id % 40 AS dir, event_id AS seq, event_id * 17 % 25 AS n, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS i,
    CASE WHEN event_id % 13 = 0 THEN 'REWIND' WHEN event_id % 11 = 0 THEN 'SEEK' WHEN event_id % 5 = 0 THEN 'TELL' ELSE 'READ' END AS op FROM events),
e AS (SELECT dir, name, row_number() OVER (PARTITION BY dir ORDER BY name) - 1 AS rank, count(*) OVER (PARTITION BY dir) AS most
  FROM (SELECT DISTINCT page_id % 39 AS dir, url AS name FROM pages)),
c AS (SELECT dir, max(most) AS most FROM e GROUP BY 1),
st AS (
  SELECT dir, i, 0::BIGINT AS at FROM o WHERE i = 1
  UNION ALL SELECT o.dir, o.i + 1, CASE o.op WHEN 'REWIND' THEN 0 WHEN 'SEEK' THEN o.n WHEN 'READ' THEN st.at + CASE WHEN st.at < coalesce(c.most, 0) THEN 1 ELSE 0 END ELSE st.at END
  FROM st JOIN o ON o.dir = st.dir AND o.i = st.i LEFT JOIN c ON c.dir = o.dir)
SELECT o.dir, o.seq, o.op, CASE WHEN o.op IN ('READ', 'TELL') THEN st.at END AS pos, CASE WHEN o.op = 'READ' THEN e.name END AS name
FROM o JOIN st ON st.dir = o.dir AND st.i = o.i LEFT JOIN e ON e.dir = o.dir AND e.rank = st.at""",
    "scan_conversions": """WITH p AS (SELECT p_partkey AS n, p_partkey % 3 AS k, '0x' || printf('%x', p_partkey) AS h, '0' || printf('%o', p_partkey) AS o FROM part)
SELECT n AS p_partkey, CASE k WHEN 0 THEN h ELSE n::VARCHAR END AS whole, CASE k WHEN 0 THEN o WHEN 1 THEN '017' END AS octal,
  CASE k WHEN 0 THEN (length(h) + 2 + length(o))::VARCHAR WHEN 1 THEN (length(n::VARCHAR) + 4)::VARCHAR END AS upto, CASE k WHEN 0 THEN 'e' WHEN 1 THEN 'z' END AS letter FROM p""",
    "dispatch_results": f"""WITH {BATCHES}, t AS (SELECT gfid, batch, max_by("offset", pos) AS cut FROM good WHERE op = 'TRUNC' GROUP BY ALL),
w AS (SELECT gfid, batch, max("offset" + nbytes) AS upto FROM good WHERE op IN ('WRITE', 'ZERO') AND nbytes > 0 GROUP BY ALL),
b AS (SELECT DISTINCT gfid, batch FROM good), k AS (SELECT b.gfid, b.batch, max(t.batch) AS since FROM b LEFT JOIN t ON t.gfid = b.gfid AND t.batch < b.batch GROUP BY ALL),
z AS (
  SELECT k.gfid, k.batch, greatest(coalesce(any_value(t.cut), any_value(f.size)), coalesce(max(w.upto), 0)) AS before
  FROM k JOIN f USING (gfid) LEFT JOIN t ON t.gfid = k.gfid AND t.batch = k.since
  LEFT JOIN w ON w.gfid = k.gfid AND w.batch < k.batch AND w.batch > coalesce(k.since, -1) GROUP BY ALL)
SELECT p.batch, p.pos, p.op, p.gfid, p.phase::INT AS phase, p.turn,
  CASE WHEN p.bad OR (p.turn IS NOT NULL AND p.gfid >= 10 AND p.op <> 'SYNC_DATA') THEN 'EINVAL' ELSE 'OK' END AS rc,
  (CASE WHEN p.turn IS NULL OR p.gfid >= 10 THEN 0 WHEN p.op = 'READ' THEN greatest(0, least(p.nbytes, z.before - p."offset")) WHEN p.op IN ('WRITE', 'ZERO') THEN p.nbytes ELSE 0 END)::BIGINT AS count,
  p.turn IS NOT NULL AND CASE WHEN p.op = 'SYNC_DATA' THEN row_number() OVER (PARTITION BY p.batch, p.op ORDER BY p.pos) = 1 ELSE p.gfid < 10 END AS acts
FROM p LEFT JOIN z ON z.gfid = p.gfid AND z.batch = p.batch""",
    "dispatch_effects": f"""WITH {BATCHES}, w AS (
  SELECT batch * 1048576 + turn AS seq, batch, gfid, "offset" AS f, "offset" + nbytes - 1 AS t, op = 'ZERO' AS zero FROM good WHERE op IN ('WRITE', 'ZERO') AND nbytes > 0 AND gfid < 10),
c AS (SELECT gfid, batch, "offset" AS cut FROM good WHERE op = 'TRUNC'),
pts AS (SELECT gfid, f AS p FROM w UNION SELECT gfid, t + 1 FROM w UNION SELECT gfid, cut FROM c),
cuts AS (SELECT gfid, p AS a, lead(p) OVER (PARTITION BY gfid ORDER BY p) - 1 AS b FROM pts),
pieces AS (
  SELECT s.gfid, s.a, s.b, w.seq, w.zero, w.seq * 10000 + s.a - w.f AS log_pos FROM cuts s JOIN w ON w.gfid = s.gfid AND w.f <= s.a AND s.b <= w.t
  WHERE s.b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.gfid = w.gfid AND c.batch >= w.batch AND c.cut <= s.a)
  QUALIFY row_number() OVER (PARTITION BY s.gfid, s.a ORDER BY w.seq DESC) = 1),
{runs("held", ["seq"], ["seq", "zero"])} SELECT gfid, start, "end", seq, zero FROM held""",
    "chunk_order": f"""WITH {READS} SELECT req_id, svr_rank, "offset", length, (row_number() OVER (PARTITION BY req_id ORDER BY svr_rank, "offset"))::INT AS place FROM chunks""",
    "callback_turns": f"""WITH {LOG}, e AS (SELECT DISTINCT seq // 100 AS round, (seq % 3)::INT AS kind, app_id, cli_id % 8 AS cli_id, gfid FROM write_log)
SELECT *, (row_number() OVER (PARTITION BY round ORDER BY kind, app_id, cli_id, gfid))::INT AS turn FROM e""",
    "extent_add": f"""WITH {LOG}, both_logs AS (
  SELECT * REPLACE (CASE WHEN seq % 2 = 0 THEN seq - 1000000000 ELSE seq END AS seq) FROM write_log WHERE seq % 2 = 0 OR (gfid < 8 AND gfid <> 3)),
{PIECES.format(log="both_logs")},\n{runs("runs", ["svr_rank", "cli_id"], ["svr_rank", "cli_id"])} SELECT gfid, start, "end", svr_rank, cli_id, log_pos FROM runs""",
    "extent_add_results": f"""WITH {LOG} SELECT gfid, CASE WHEN gfid >= 8 THEN 'ENOENT' WHEN gfid = 3 THEN 'EINVAL' ELSE 'OK' END AS rc, count(*) AS n,
  CASE WHEN gfid < 8 THEN CASE WHEN gfid = 3 THEN 6000 ELSE greatest(gfid * 2000, max(file_pos + length)) END END::BIGINT AS size FROM write_log GROUP BY gfid""",
    "file_truncate": f"""WITH {EXTENTS}, s AS (SELECT range::INT AS gfid, range < 8 AND range <> 3 AS good, range * 1000 AS size FROM range(10)),
e AS (SELECT gfid, count(*) AS n, max(CASE WHEN good THEN least("end", size - 1) ELSE "end" END) AS m FROM extents JOIN s USING (gfid) WHERE NOT good OR start < size GROUP BY 1)
SELECT s.gfid, CASE WHEN gfid >= 8 THEN 'ENOENT' WHEN gfid = 3 THEN 'EINVAL' ELSE 'OK' END AS rc, CASE WHEN good THEN size WHEN gfid = 3 THEN 9000 END AS size,
  e.n AS n_extents, e.m AS max_offset FROM s LEFT JOIN e USING (gfid)""",
    "write_records": f"""WITH {LOG}, c AS (SELECT *, (length + 99) // 100 AS k FROM write_log)
SELECT seq, gfid, cli_id, file_pos, length, (sum(k) OVER (PARTITION BY cli_id ORDER BY seq) - k)::BIGINT * 100 AS log_pos, k::BIGINT AS n_chunks FROM c""",
    "log_bytes": """WITH d AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n, doc_id * 37 % 600 AS s FROM documents)
SELECT doc_id AS req_id, least(300, n - s)::BIGINT AS n, md5(unhex(substr(h, (2 * s + 1)::BIGINT, (2 * least(300, n - s))::BIGINT))) AS md5 FROM d WHERE n > s""",
    "stage_run": """WITH p AS (SELECT page_id AS n, page_id % 7 AS k, strlen(html) AS size, (strlen(html) + 63) // 64 AS blocks FROM pages),
q AS (SELECT *, greatest(8, (blocks + 2) // 3) AS per, CASE WHEN k > 1 AND size IS NOT NULL THEN size END AS got FROM p)
SELECT n AS line_no, CASE WHEN k > 0 THEN '/in/' || CASE WHEN k = 1 THEN n + 1000000 ELSE n END END AS src, CASE WHEN k > 0 THEN '/out/a ' || n END AS dst,
  CASE WHEN k = 0 THEN 'EINVAL' WHEN got IS NULL THEN 'ENOENT' WHEN k = 2 THEN 'EIO' ELSE 'OK' END AS rc, coalesce(got, 0)::BIGINT AS n_bytes,
  CASE WHEN got IS NULL THEN 0 ELSE len(list_filter([0, 1, 2], lambda r: r * per < blocks)) END::BIGINT AS n_ranks,
  CASE WHEN got IS NOT NULL THEN list_max(list_transform(list_filter([0, 1, 2], lambda r: r * per < blocks), lambda r: (n * 7 + r * 5) % 11)) END::DOUBLE AS seconds FROM q""",
    "config_more_functions": f"""WITH t AS (SELECT s_suppkey, (s_suppkey % 40 - 3)::DOUBLE / 8 AS x, (s_suppkey % 21 - 10)::DOUBLE / 10 AS u, s_suppkey % 9 AS n, s_suppkey % 4 AS r FROM supplier),
v AS (SELECT s_suppkey, abs(x) AS f_abs, atan(x) AS f_atan, cos(x) AS f_cos, cosh(x) AS f_cosh, exp(x) AS f_exp, sin(x) AS f_sin, sinh(x) AS f_sinh, tan(x) AS f_tan, tanh(x) AS f_tanh,
  acos(u) AS f_acos, asin(u) AS f_asin, sqrt(abs(x)) AS f_sqrt, CASE WHEN x = 0 AND u < 0 THEN 'inf'::DOUBLE ELSE pow(abs(x), u) END AS f_pow, exp(1) * x AS f_e, pi() * x AS f_pi,
  CASE WHEN n < r THEN 'nan'::DOUBLE ELSE coalesce(list_product(list_transform(range(0, r), lambda i: n - i)), 1) END AS f_npr FROM t)
SELECT s_suppkey, {", ".join(_NUM.format(f"f_{c}") + f" AS f_{c}" for c in ("abs", "atan", "cos", "cosh", "exp", "sin", "sinh", "tan", "tanh", "acos", "asin", "sqrt", "pow", "e", "pi", "npr"))} FROM v""",
    "config_expressions": """WITH v AS (SELECT p_partkey AS n, (CASE p_partkey % 10 WHEN 0 THEN p_partkey + 6 WHEN 1 THEN p_partkey * p_partkey WHEN 2 THEN 64 - p_partkey WHEN 3 THEN p_partkey * 4
    WHEN 4 THEN 8 + p_partkey WHEN 5 THEN 4 * p_partkey WHEN 6 THEN p_partkey % 7 / 2 WHEN 7 THEN 1024 * (p_partkey - 1) WHEN 9 THEN 16 - p_partkey END)::DOUBLE AS value FROM part)
SELECT n AS p_partkey, value, trunc(value)::BIGINT AS whole FROM v""",
    "config_floats": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey + 0.25 WHEN 1 THEN (p_partkey || 'e-1')::DOUBLE WHEN 2 THEN p_partkey / 4 END::DOUBLE AS value,
  CASE p_partkey % 4 WHEN 0 THEN p_partkey WHEN 1 THEN -p_partkey WHEN 2 THEN p_partkey END AS whole FROM part""",
    "descriptor_cursors": """WITH RECURSIVE o AS (
  SELECT user_id AS fd, event_id AS seq, event_id * 7919 % 500 - 40 AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
    ['WRITE', 'READ', 'SEEK_SET', 'APPEND', 'SEEK_CUR', 'PREAD', 'SEEK_END', 'TELL', 'SEEK_DATA', 'SEEK_HOLE', 'PWRITE', 'REWIND', 'TRUNCATE'][1 + event_id * 31 % 13] AS op FROM events),
st AS (
  SELECT fd, 0::BIGINT AS i, 0::BIGINT AS ret, 0::BIGINT AS pos, 0::BIGINT AS size FROM o WHERE i = 1
  UNION ALL SELECT fd, i, ret, CASE
      WHEN op LIKE 'SEEK%' AND ret >= 0 OR op = 'REWIND' THEN ret WHEN ret < 0 THEN p WHEN op = 'READ' THEN p + ret WHEN op = 'WRITE' THEN p + n WHEN op = 'APPEND' THEN z + n ELSE p END,
    CASE WHEN ret < 0 THEN z WHEN op = 'TRUNCATE' THEN n WHEN n = 0 THEN z WHEN op = 'WRITE' THEN greatest(z, p + n) WHEN op = 'APPEND' THEN z + n WHEN op = 'PWRITE' THEN greatest(z, n) ELSE z END
  FROM (SELECT o.fd, o.i, o.op, o.n, st.pos AS p, st.size AS z, CASE
      WHEN op = 'SEEK_SET' THEN CASE WHEN n < 0 THEN -22 ELSE n END WHEN op = 'SEEK_CUR' THEN CASE WHEN st.pos + n < 0 THEN -22 ELSE st.pos + n END
      WHEN op = 'SEEK_END' THEN CASE WHEN st.size + n < 0 THEN -22 ELSE st.size + n END
      WHEN op = 'SEEK_DATA' THEN CASE WHEN n BETWEEN 0 AND st.size THEN n ELSE -6 END WHEN op = 'SEEK_HOLE' THEN CASE WHEN n BETWEEN 0 AND st.size THEN st.size ELSE -6 END
      WHEN op = 'TELL' THEN st.pos WHEN op = 'REWIND' THEN 0 WHEN n < 0 THEN -22 WHEN op = 'READ' THEN greatest(0, least(n, st.size - st.pos))
      WHEN op = 'PREAD' THEN least(n, st.size) WHEN op = 'TRUNCATE' THEN 0 ELSE n END AS ret
    FROM st JOIN o ON o.fd = st.fd AND o.i = st.i + 1))
SELECT o.fd, o.seq, o.op, o.n, st.ret, st.pos, st.size FROM o JOIN st ON st.fd = o.fd AND st.i = o.i""",
    "free_ids": """WITH RECURSIVE o AS (
  SELECT event_id // 300 AS map_id, event_id AS seq, event_id % 3 = 2 AS push, 1 + event_id * 7919 % 17 AS count, CASE WHEN event_id % 3 = 2 THEN event_id - 1 - event_id % 2 END AS ref,
    row_number() OVER (PARTITION BY event_id // 300 ORDER BY event_id) AS i FROM events),
st AS (
  SELECT map_id, 0::BIGINT AS i, list_reverse(range(64)) AS free, []::STRUCT(s BIGINT, id BIGINT)[] AS held, NULL::BIGINT AS start FROM o WHERE i = 1
  UNION ALL SELECT map_id, i, CASE WHEN id IS NULL THEN free WHEN push THEN list_append(free, id) ELSE free[:-2] END,
    CASE WHEN id IS NULL THEN held WHEN push THEN list_filter(held, lambda h: h.s <> ref) ELSE list_append(held, {'s': seq, 'id': id}) END, id
  FROM (SELECT o.map_id, o.i, o.seq, o.push, o.ref, st.free, st.held, CASE WHEN o.push THEN list_filter(st.held, lambda h: h.s = o.ref)[1].id ELSE st.free[-1] END AS id
    FROM st JOIN o ON o.map_id = st.map_id AND o.i = st.i + 1))
SELECT o.map_id, o.seq, CASE WHEN o.push THEN 'PUSH' ELSE 'POP' END AS op, o.count, st.start FROM o JOIN st ON st.map_id = o.map_id AND st.i = o.i""",
    "stream_sizes": f"WITH {LOG} SELECT gfid, max(file_pos + length) AS size, count(*) AS n_writes FROM write_log GROUP BY gfid",
    "write_out": """SELECT '/out/' || doc_id AS path, strlen(text)::BIGINT AS n_bytes, greatest(1, (strlen(text) + 63) // 64)::BIGINT AS n_parts,
  (greatest(0, strlen(text) - 1) // 64 * 64)::BIGINT AS last FROM documents""",
    "stream_sync": f'WITH {EXTENTS} SELECT gfid, start, "end", svr_rank, 1 AS app_id, cli_id, log_pos FROM extents',
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
