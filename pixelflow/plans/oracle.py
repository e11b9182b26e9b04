"""The same queries in SQL over the source tables, written from the meaning of each operator, without packets."""

from __future__ import annotations

from pixelflow.plans.virtual import EPOCH_US

DAY, TICK, WIN = 86_400_000_000, 3_600_000_000, 600_000_000

BASE = f"""
ev AS (SELECT *, epoch_us(ts) - {EPOCH_US} AS toa FROM events),
tr AS (SELECT event_id, toa, CAST(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS SMALLINT) AS tdc_id, CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS SMALLINT) AS edge
       FROM ev WHERE event_type IN ('signup', 'purchase', 'error')),
hi AS (SELECT event_id, CAST(user_id % 300 - 20 AS INTEGER) AS x, CAST(event_id % 256 AS INTEGER) AS y, toa, CAST(round(value * 100) AS BIGINT) % 1024 * 25 AS tot
       FROM ev WHERE event_type IN ('view', 'click')),
pt AS (SELECT DISTINCT toa AS t_trigger FROM tr WHERE tdc_id = 1 AND edge = 0),
co AS (SELECT h.*, p.t_trigger, h.toa - p.t_trigger AS tof FROM hi h ASOF JOIN pt p ON h.toa >= p.t_trigger
       WHERE p.t_trigger < (SELECT max(t_trigger) FROM pt) AND h.toa - p.t_trigger BETWEEN 0 AND {WIN})"""

LINE = """
li AS (SELECT CAST(l_orderkey AS BIGINT) AS k1, CAST(l_linenumber AS BIGINT) AS k2, CAST(l_partkey AS BIGINT) AS p, CAST(l_suppkey AS BIGINT) AS s, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS f,
         (CAST(l_orderkey AS BIGINT) * 1000003) % 1099511627776 AS m FROM lineitem),
px AS (SELECT *, ((((k1 * 13) % 65536) * 16384 + k1 % 16384) * 16 - p % 16) AS raw FROM li WHERE f <> 'R'),
pe AS (SELECT *, (((raw - m % 17179869184) % 17179869184) + 17179869184) % 17179869184 AS d FROM px),
pa AS (SELECT *, m + CASE WHEN d >= 8589934592 THEN d - 17179869184 ELSE d END AS toa_ticks FROM pe),
te AS (SELECT *, ((((k1 * 7919 + p) % 34359738368 * 2 - m % 68719476736) % 68719476736) + 68719476736) % 68719476736 AS d FROM li WHERE f = 'R'),
ta AS (SELECT *, 6 * (m + CASE WHEN d >= 34359738368 THEN d - 68719476736 ELSE d END) + s % 16 - 1 AS ticks,
         CAST(CASE k2 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 0 END AS SMALLINT) AS tdc_id, CAST(CASE k2 WHEN 2 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS SMALLINT) AS edge FROM te)"""

PIXEL_SUMS = """SELECT CAST((p % 128) * 2 + (k2 % 8) // 4 AS INTEGER) AS x, CAST((s % 64) * 4 + k2 % 4 AS INTEGER) AS y, count(*) AS n, CAST(sum((q * 7) % 1024 * 25) AS BIGINT) AS tot
FROM px WHERE k1 IN (SELECT k1 FROM li GROUP BY k1 HAVING count(*) > 1) GROUP BY 1, 2"""

POINTS = """
pt AS (SELECT CAST(l_orderkey AS BIGINT) AS shot, CAST(l_linenumber AS BIGINT) AS pid, CAST(min(l_partkey % 40) AS DOUBLE) AS x, CAST(min(l_suppkey % 40) AS DOUBLE) AS y, CAST(max(l_quantity) AS BIGINT) AS tot FROM lineitem GROUP BY 1, 2),
nb AS (SELECT a.shot, a.pid, b.pid AS other FROM pt a JOIN pt b ON a.shot = b.shot AND a.pid <> b.pid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 36),
reach(shot, pid, root) AS (SELECT DISTINCT shot, pid, pid FROM nb UNION SELECT n.shot, n.pid, r.root FROM nb n JOIN reach r ON n.shot = r.shot AND n.other = r.pid),
lab AS (SELECT shot, pid, min(root) AS root FROM reach GROUP BY ALL),
clu AS (SELECT shot, pid, dense_rank() OVER (PARTITION BY shot ORDER BY root) - 1 AS cluster FROM lab)"""

ROI = "(VALUES ('early', 0, 60000000), ('middle', 50000000, 300000000), ('late', 300000001, 600000000)) r(roi, lo, hi)"
REGIONS = "(VALUES ('first', 0, 60000000, -9000000000000000), ('middle', 20000000, 200000000, 5000000000000), ('late', 300000001, 600000000, -9000000000000000)) r(roi, lo, hi, since)"
CLEARED = 5_000_000_000_000
CLIP = "greatest(0, least(255, x))"


#: The greedy pass as a recursion over the hits of each buffer: 16 slots of open clusters, and those that each hit closes.
GREEDY = f"""WITH RECURSIVE {BASE},
h AS (SELECT toa // {DAY} AS buffer, x, y, toa, tot, row_number() OVER (PARTITION BY toa // {DAY} ORDER BY toa, x, y, tot) AS k FROM hi),
st(buffer, k, slots, closed) AS (
  SELECT DISTINCT buffer, CAST(0 AS BIGINT), list_transform(range(16), lambda i: CAST(NULL AS STRUCT(x INTEGER, y INTEGER, t BIGINT, w BIGINT))), CAST([] AS STRUCT(x INTEGER, y INTEGER, t BIGINT, w BIGINT)[]) FROM h
  UNION ALL
  SELECT buffer, k, list_transform(live, lambda c, i: CASE WHEN i = pos THEN CASE WHEN near IS NULL THEN {{'x': x, 'y': y, 't': toa, 'w': tot}} WHEN tot > c.w THEN {{'x': x, 'y': y, 't': c.t, 'w': tot}} ELSE c END ELSE c END),
         CASE WHEN near IS NULL AND live[pos] IS NOT NULL THEN list_append(gone, live[pos]) ELSE gone END
  FROM (SELECT *, CASE WHEN near IS NOT NULL THEN list_position(far, near) WHEN list_contains(taken, false) THEN list_position(taken, false) ELSE list_position(starts, list_min(starts)) END AS pos
    FROM (SELECT *, list_min(far) AS near, list_transform(live, lambda c: c IS NOT NULL) AS taken, list_transform(live, lambda c: c.t) AS starts
      FROM (SELECT *, list_transform(live, lambda c: CASE WHEN abs(x - c.x) + abs(y - c.y) <= 40 THEN abs(x - c.x) + abs(y - c.y) END) AS far
        FROM (SELECT h.buffer, h.k, h.x, h.y, h.toa, h.tot, list_transform(st.slots, lambda c: CASE WHEN h.toa - c.t <= 900000000 THEN c END) AS live, list_filter(st.slots, lambda c: c IS NOT NULL AND h.toa - c.t > 900000000) AS gone
          FROM st JOIN h ON h.buffer = st.buffer AND h.k = st.k + 1))))),
done AS (SELECT buffer, unnest(closed) AS c FROM st UNION ALL SELECT buffer, unnest(list_filter(arg_max(slots, k), lambda c: c IS NOT NULL)) FROM st GROUP BY buffer)
SELECT buffer, c.x AS x, c.y AS y, c.t AS toa, c.w AS tot FROM done"""


def _hist(rows: str, col: str, low: int, high: int, bins: int) -> str:
    w = (high - low) / bins
    return f"""SELECT bin, CAST(bin * {w!r} + {low} AS DOUBLE) AS lo, CAST((bin + 1) * {w!r} + {low} AS DOUBLE) AS hi, CAST((bin + 0.5) * {w!r} + {low} AS DOUBLE) AS center, count(*) AS "count" FROM (
  SELECT CAST(CASE WHEN {col} = {high} THEN {bins - 1} ELSE ({col} - {low}) * {bins} // {high - low} END AS INTEGER) AS bin FROM {rows} WHERE {col} BETWEEN {low} AND {high}) GROUP BY bin"""


def _rates(shots: str, digits: int) -> str:
    return f"""by_tick AS (SELECT t_trigger // {TICK} AS tick, count(*) AS n_total, count(*) FILTER (tof BETWEEN 0 AND 60000000) AS n0, count(*) FILTER (tof BETWEEN 50000000 AND 300000000) AS n1, count(*) FILTER (tof BETWEEN 300000001 AND 600000000) AS n2, {shots} AS sh FROM co GROUP BY ALL),
ser AS (SELECT tick, u.series, CAST(round(CASE WHEN $S <= 0 THEN CAST(u.n AS DOUBLE) ELSE u.n / $S END, {digits}) AS DOUBLE) AS rate FROM (SELECT *, $W AS d FROM by_tick),
  LATERAL (SELECT unnest([{{'series': 'total', 'n': n_total}}, {{'series': 'early', 'n': n0}}, {{'series': 'middle', 'n': n1}}, {{'series': 'late', 'n': n2}}]) AS u))"""


PER_SHOT = _rates("count(DISTINCT t_trigger)", 6).replace("$S", "d").replace("$W", "sh")
COMPAT = _rates("max(t_trigger // 1000000)", 9).replace("$S", "d").replace("$W", "max(sh) OVER (ORDER BY tick) - coalesce(max(sh) OVER (ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")


def oracle_sql() -> dict[str, str]:
    ev, li, po = (lambda q, b=b: f"WITH RECURSIVE {b} {q}" for b in (BASE, LINE, POINTS))
    more = lambda extra, q: f"WITH {BASE}, {extra} {q}"
    return {
        "classify_packets": li("SELECT kind, CAST(sub AS INTEGER) AS sub, count(*) AS n FROM (SELECT CASE WHEN f = 'R' THEN 'trigger' ELSE 'pixel' END AS kind, CASE WHEN f <> 'R' THEN (p % 128) // 8 ELSE CASE k2 WHEN 1 THEN 15 WHEN 2 THEN 10 WHEN 3 THEN 14 WHEN 4 THEN 11 ELSE 12 END END AS sub FROM li) GROUP BY ALL"),
        "decode_pixel_address": li("SELECT k1, k2, CAST((p % 128) * 2 + (k2 % 8) // 4 AS INTEGER) AS x, CAST((s % 64) * 4 + k2 % 4 AS INTEGER) AS y FROM px"),
        "decode_pixel_time": li("SELECT k1, k2, raw, (q * 7) % 1024 * 25 AS tot FROM px"),
        "extend_timestamp": li("SELECT k1, k2, toa_ticks FROM pa"),
        "decode_trigger": li("SELECT k1, k2, ticks, tdc_id, edge FROM ta"),
        "ticks_to_seconds": li("SELECT 'pixel' AS stream, round(max(toa_ticks) * CAST(1.5625e-9 AS DOUBLE), 6) AS latest, count(*) AS n FROM pa UNION ALL SELECT 'trigger', round(max(ticks) * CAST(260.41666e-12 AS DOUBLE), 6), count(*) FROM ta"),
        "time_range": li("SELECT min(m) AS min_ts, max(m + 1000) AS max_ts FROM li"),
        "filter_triggers": ev("SELECT * FROM tr WHERE edge = 0"),
        "primary_triggers": ev("SELECT * FROM tr WHERE tdc_id = 1 AND edge = 0"),
        "correlate_live": ev("SELECT event_id, t_trigger, x, y, tof, tot FROM co"),
        "correlate_live_by_buffer": ev(f"SELECT h.event_id, h.toa // {DAY} AS buffer, p.t_trigger, h.toa - p.t_trigger AS tof FROM hi h ASOF JOIN pt p ON h.toa >= p.t_trigger JOIN (SELECT t_trigger // {DAY} AS b, max(t_trigger) AS last FROM pt GROUP BY 1) l ON l.b = h.toa // {DAY} WHERE p.t_trigger // {DAY} = h.toa // {DAY} AND p.t_trigger < l.last AND h.toa - p.t_trigger <= {WIN}"),
        "correlate_offline": ev(f"SELECT h.event_id, p.event_num, h.toa - p.t AS tof FROM hi h ASOF JOIN (SELECT t, max(n) AS event_num FROM (SELECT toa AS t, row_number() OVER (ORDER BY toa) - 1 AS n FROM tr WHERE tdc_id = 1 AND edge = 0) GROUP BY t) p ON h.toa >= p.t WHERE h.toa - p.t <= {WIN}"),
        "shot_index": ev("SELECT event_id, t_trigger, n AS shot_index FROM co JOIN (SELECT toa AS t, min(n) AS n FROM (SELECT toa, row_number() OVER (ORDER BY toa) - 1 AS n FROM tr) GROUP BY toa) ON t = t_trigger"),
        "tof_correction": ev("SELECT event_id, round(CASE WHEN tot <= 1000 THEN 0.5 WHEN tot < 5000 THEN 0.5 + (tot - 1000) * 2.0 / 4000 WHEN tot < 12000 THEN 2.5 + (tot - 5000) * 1.5 / 7000 WHEN tot < 20000 THEN 4.0 - (tot - 12000) * 1.0 / 8000 ELSE 3.0 END::DOUBLE, 6) AS correction FROM hi"),
        "tof_histogram": ev(_hist("co", "tof", 0, WIN, 1000)),
        "toa_histogram": ev(_hist("hi", "toa", 0, 40_000_000_000_000, 500)),
        "pixel_image": ev(f'SELECT {CLIP} AS x, greatest(0, least(255, y)) AS y, count(*) AS "count" FROM hi GROUP BY 1, 2'),
        "roi_images": ev(f'SELECT roi, {CLIP} AS x, y, count(*) AS "count" FROM co JOIN {ROI} ON tof BETWEEN lo AND hi GROUP BY ALL'),
        "roi_counts": ev(f'SELECT roi, count(tof) AS "count", (SELECT count(*) FROM co) AS total, round(count(tof) * 100.0::DOUBLE / (SELECT count(*) FROM co), 6) AS yield_pct FROM {ROI} LEFT JOIN co ON tof BETWEEN lo AND hi GROUP BY roi'),
        "accumulator_stats": ev("SELECT (SELECT count(*) FROM co) AS total_events, count(*) AS total_pixels, CAST(sum(tot) AS BIGINT) AS pixel_sum FROM hi"),
        "timeseries_per_shot": more(PER_SHOT, "SELECT * FROM ser"),
        "timeseries_compat": more(COMPAT, "SELECT * FROM ser"),
        "series_last_n": more(PER_SHOT, "SELECT tick, series, rate FROM ser QUALIFY row_number() OVER (PARTITION BY series ORDER BY tick DESC) <= 20"),
        "running_trigger_max": ev(f"SELECT tick, max(m) OVER (ORDER BY tick) AS running_max FROM (SELECT toa // {TICK} AS tick, max(t_trigger) AS m FROM co GROUP BY 1)"),
        "stride_sample": ev(f"SELECT event_id, toa // {DAY} AS batch FROM hi QUALIFY (row_number() OVER (PARTITION BY toa // {DAY} ORDER BY event_id) - 1) % 2 = 0"),
        "clipped_hits": ev(f"SELECT event_id, {CLIP} AS x, y FROM hi"),
        "threshold_filter": ev("SELECT event_id, tof FROM co WHERE tof <= 100000000"),
        "merge_triggers": ev("SELECT event_id, toa, row_number() OVER (ORDER BY toa, event_id) - 1 AS position FROM tr"),
        "shot_table": ev("SELECT t_trigger, dense_rank() OVER (ORDER BY t_trigger) - 1 AS shot FROM (SELECT DISTINCT t_trigger FROM co)"),
        "events_for_shot": ev("SELECT * FROM (SELECT event_id, dense_rank() OVER (ORDER BY t_trigger) - 1 AS shot, t_trigger FROM co) WHERE shot = 7"),
        "events_in_range": ev("SELECT * FROM (SELECT event_id, dense_rank() OVER (ORDER BY t_trigger) - 1 AS shot, t_trigger FROM co) WHERE shot BETWEEN 10 AND 59"),
        "absolute_times": ev("SELECT event_id, toa AS t_abs FROM co"),
        "run_summary": ev(f"SELECT run, coalesce(ne, 0) AS n_events, coalesce(nt, 0) AS n_triggers, coalesce(dt, de) AS duration FROM (SELECT toa // {DAY} AS run, count(*) AS ne, max(t_trigger) - min(t_trigger) AS de FROM co GROUP BY 1) FULL JOIN (SELECT toa // {DAY} AS run, count(*) AS nt, max(toa) - min(toa) AS dt FROM tr GROUP BY 1) USING (run)"),
        "run_status": """WITH f AS (SELECT o_custkey % 500 AS run, CASE o_orderstatus WHEN 'F' THEN 'events' WHEN 'O' THEN 'centroids' ELSE 'raw' END AS kind, o_orderkey % 7 * 48 AS size, o_orderdate AS m FROM orders),
g AS (SELECT run, count(*) FILTER (kind = 'events') AS n_files, max(m) FILTER (kind = 'events') AS newest, max(m) FILTER (kind = 'centroids' AND size > 0) AS made, coalesce(sum(size // 48) FILTER (kind = 'centroids' AND size > 0), 0) AS n FROM f WHERE run % 3 = 0 OR kind <> 'events' GROUP BY run)
SELECT run, CASE WHEN n_files = 0 THEN 'EMPTY' WHEN made IS NULL THEN 'READY' WHEN made < newest THEN 'STALE' ELSE 'DONE' END AS status, n_files, CAST(n AS BIGINT) AS n_centroids FROM g""",
        "rebased_shots": ev("SELECT event_id, event_id % 4 AS file, t_trigger // 1000000 - min(t_trigger // 1000000) OVER (PARTITION BY event_id % 4) + 1 AS shot FROM co"),
        "eps_neighbours": po("SELECT shot, pid, count(*) AS n FROM nb GROUP BY ALL"),
        "density_labels": po("SELECT pt.shot, pt.pid, coalesce(cluster, -1) AS cluster FROM pt LEFT JOIN clu USING (shot, pid)"),
        "density_in_boxes": po("SELECT pt.shot, pt.pid, coalesce(cluster, -1) AS cluster FROM pt LEFT JOIN clu USING (shot, pid)"),
        "density_numbered": po("SELECT shot, pid, dense_rank() OVER (ORDER BY shot, cluster) - 1 AS label FROM clu"),
        "centroids_weighted": po("SELECT shot, cluster, round(sum(x * tot) / sum(tot), 6) AS x, round(sum(y * tot) / sum(tot), 6) AS y, 0.0::DOUBLE AS tof, max(tot) AS tot FROM pt JOIN clu USING (shot, pid) GROUP BY ALL"),
            "sorted_hits": ev("SELECT event_id, toa, row_number() OVER (ORDER BY toa, event_id) - 1 AS position FROM hi"),
        "correlate_offline_by_buffer": more(f"""b AS (SELECT toa // {TICK} AS buffer, toa, row_number() OVER (PARTITION BY toa // {TICK} ORDER BY toa) - 1 AS n, count(*) OVER (PARTITION BY toa // {TICK}) AS size FROM tr WHERE tdc_id = 1 AND edge = 0),
bt AS (SELECT buffer, toa AS t, max(n) AS event_num FROM b WHERE size >= 2 GROUP BY ALL), bh AS (SELECT *, toa // {TICK} AS buffer FROM hi)""",
            f"SELECT h.event_id, h.buffer, p.event_num, h.toa - p.t AS tof FROM bh h ASOF JOIN bt p ON h.buffer = p.buffer AND h.toa >= p.t WHERE h.toa - p.t BETWEEN 0 AND {WIN}"),
        "display_mode": ev("SELECT event_id, 'events' AS mode FROM co UNION ALL SELECT event_id, 'pixels' FROM hi"),
        "auto_clear_images": ev(f'SELECT toa // {DAY} AS period, {CLIP} AS x, greatest(0, least(255, y)) AS y, count(*) AS "count" FROM hi GROUP BY 1, 2, 3'),
        "image_since_clear": ev(f'SELECT {CLIP} AS x, greatest(0, least(255, y)) AS y, count(*) AS "count" FROM hi WHERE toa >= {CLEARED} GROUP BY 1, 2'),
        "roi_lifecycle": ev(f'SELECT roi, count(tof) AS "count", CAST(lo AS BIGINT) AS low, CAST(hi AS BIGINT) AS high FROM {REGIONS} LEFT JOIN co ON tof BETWEEN lo AND hi AND toa >= since GROUP BY roi, lo, hi'),
        "roi_lifecycle_images": ev(f'SELECT roi, {CLIP} AS x, greatest(0, least(255, y)) AS y, count(*) AS "count" FROM co JOIN {REGIONS} ON tof BETWEEN lo AND hi AND toa >= since GROUP BY 1, 2, 3'),
        "single_roi": ev("""SELECT 'ROI' AS roi, count(*) FILTER (tof BETWEEN 0 AND 100000000) AS "count", CAST(0 AS BIGINT) AS low, CAST(100000000 AS BIGINT) AS high FROM co"""),
        "accumulator_stats_by_roi": ev("SELECT (SELECT count(*) FROM co) AS total_events, " + ", ".join(f"(SELECT count(*) FROM co WHERE tof BETWEEN {a} AND {b}) AS roi_{n}" for n, a, b in (("early", 0, 60000000), ("middle", 50000000, 300000000), ("late", 300000001, 600000000))) + ", count(*) AS total_pixels, CAST(sum(tot) AS BIGINT) AS pixel_sum FROM hi"),
        "coalesced_updates": ev(f"SELECT toa // {TICK} AS update, min(toa) AS t_sent, count(*) AS n_batches, CAST(sum(tot) AS BIGINT) AS tot FROM hi GROUP BY 1"),
        "chunk_diagnostics": more(f"ch AS (SELECT toa // {TICK} AS chunk, count(*) AS n_hits, sum(tot) AS tot FROM hi GROUP BY 1), cn AS (SELECT *, (row_number() OVER (ORDER BY chunk) - 1) // 8 AS block FROM ch)",
            "SELECT block, count(*) AS n_chunks, CAST(sum(n_hits) AS BIGINT) AS n_hits, CAST(sum(tot) AS BIGINT) AS tot FROM cn GROUP BY 1"),
        "parse_frames": li("SELECT CAST(k1 AS VARCHAR) AS path, CAST(0 AS BIGINT) AS frame, min(m) AS min_ts, max(m) + 1000 AS max_ts, CAST(count(*) AS INTEGER) AS n_packets FROM li GROUP BY k1 HAVING count(*) > 1"),
        "parse_packets": li("SELECT CAST(k1 AS VARCHAR) AS path, CAST((p % 128) * 2 + (k2 % 8) // 4 AS INTEGER) AS x, CAST((s % 64) * 4 + k2 % 4 AS INTEGER) AS y, count(*) AS n, CAST(sum((q * 7) % 1024 * 25) AS BIGINT) AS tot FROM px WHERE k1 IN (SELECT k1 FROM li GROUP BY k1 HAVING count(*) > 1) GROUP BY 1, 2, 3"),
        "split_frames": li(PIXEL_SUMS),
        "followed_frames": li(PIXEL_SUMS),
        "correlate_stream": ev(f"SELECT x, y, h.toa, tot, p.t_trigger, h.toa - p.t_trigger AS tof FROM hi h ASOF JOIN pt p ON h.toa >= p.t_trigger WHERE h.toa - p.t_trigger BETWEEN 0 AND {WIN}"),
        "streamed_pixels": ev(f"SELECT {CLIP} AS x, greatest(0, least(255, y)) AS y, CAST(toa AS DOUBLE) AS toa, tot FROM hi"),
        "filtered_scan": ev(f"SELECT {CLIP} AS x, greatest(0, least(255, y)) AS y, CAST(toa AS DOUBLE) AS toa, tot FROM hi WHERE toa >= 5000000000000 AND toa < {5_000_000_000_000 + 10 * DAY}"),
        "live_accumulators": ev(f"SELECT 'image' AS acc, toa // {DAY} AS day, greatest(0, least(255, y)) AS shard, CAST({CLIP} AS BIGINT) AS slot, count(*) AS count FROM co GROUP BY ALL UNION ALL SELECT 'spectrum', toa // {DAY}, CAST(b // 64 AS INTEGER), b, count(*) FROM (SELECT toa, CAST(least(999, floor(tof * 1000.0 / {WIN})) AS BIGINT) AS b FROM co) GROUP BY ALL UNION ALL SELECT 'roi', toa // {DAY}, r, CAST(0 AS BIGINT), count(*) FROM co JOIN (VALUES (0, 0, 60000000), (1, 50000000, 300000000), (2, 300000001, 600000000)) v(r, lo, hi) ON tof BETWEEN lo AND hi GROUP BY ALL"),
        "recorded_events": ev(f"SELECT CAST(t_trigger AS DOUBLE) AS t_trigger, {CLIP} AS x, greatest(0, least(255, y)) AS y, CAST(tof AS DOUBLE) AS tof, tot FROM co"),
        "recorded_pixels": ev(f"SELECT {CLIP} AS x, greatest(0, least(255, y)) AS y, CAST(toa AS DOUBLE) AS toa, tot FROM hi"),
        "recorded_triggers": ev("SELECT CAST(toa AS DOUBLE) AS toa, tdc_id, edge FROM tr"),
        "tofbin_scan": ev(f"SELECT CAST(t_trigger AS DOUBLE) AS shot, CAST({CLIP} AS DOUBLE) AS x, CAST(greatest(0, least(255, y)) AS DOUBLE) AS y, CAST(tof AS DOUBLE) AS tof, CAST(tot AS DOUBLE) AS tot FROM co"),
        "corrections_scan": "SELECT CAST(p_partkey AS DOUBLE) AS tof, CAST(p_retailprice AS DOUBLE) AS correction FROM part",
        "run_events": po("SELECT row_number() OVER (ORDER BY shot, x, y, tot) - 1 AS position, CAST(shot AS DOUBLE) AS t_trigger, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, tot FROM pt"),
        "merged_run": po("SELECT i.n AS shot_index, CAST(shot AS DOUBLE) AS t_trigger, round(sum(x * tot) / sum(tot), 6) AS x, round(sum(y * tot) / sum(tot), 6) AS y, 0.0::DOUBLE AS tof, CAST(max(tot) AS DOUBLE) AS tot FROM pt JOIN clu USING (shot, pid) JOIN (SELECT shot, row_number() OVER (ORDER BY shot) - 1 AS n FROM (SELECT DISTINCT shot FROM pt)) i USING (shot) GROUP BY shot, cluster, i.n"),
        "label_files": po("SELECT CAST(pt.shot AS DOUBLE) AS shot, x, y, CAST(tot AS DOUBLE) AS tot, cluster IS NOT NULL AS clustered FROM pt LEFT JOIN clu USING (shot, pid)"),
        "numbered_label_files": po("SELECT count(DISTINCT (shot, cluster)) AS n_labels, count(DISTINCT (shot, cluster)) - 1 AS largest, count(*) AS n_events FROM clu"),
        "run_folder_status": po("SELECT 'run' AS run, 'DONE' AS status, CAST(count(DISTINCT (shot, cluster)) AS BIGINT) AS n_centroids FROM clu"),
        "greedy_centroids": GREEDY,
    }
