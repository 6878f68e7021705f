"""DuckDB SQL for the driver queries: same columns and values, written for that engine."""

from __future__ import annotations

from lumenfold.file_queries import JPEG_HEAD, JPEG_TAIL
from lumenfold.options import EXTRA_SUFFIXES

MEDIA = """
media AS (
  SELECT doc_id AS ord, CASE WHEN doc_id % 2 = 1 THEN source END AS album,
         'IMG_' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '-edited' ELSE '' END || '.jpg' AS name,
         CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS hash
  FROM documents),
keyed AS (
  SELECT ord, album, '/in/' || name AS path, name, size,
         CASE WHEN count(*) OVER (PARTITION BY size) = 1 THEN size || 'bytes' ELSE hash END AS content_key
  FROM media)"""

SURVIVORS = f"""{MEDIA},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY album, size, content_key ORDER BY '999' || length(name), ord) AS rn FROM keyed),
survivors AS (SELECT * FROM ranked WHERE rn = 1)"""

DATED = f"""{SURVIVORS},
dated AS (
  SELECT ord, album, path, name, size, content_key,
         CASE WHEN ord % 3 <> 0 THEN 1500000000 + ord * 86413 END AS epoch,
         CASE WHEN ord % 3 <> 0 THEN CAST(ord % 4 AS INTEGER) END AS accuracy
  FROM survivors)"""

MERGED = """
by_album AS (
  SELECT size, content_key, album, min(ord) AS first, arg_max(path, ord) AS path, count(*) AS n FROM {src} GROUP BY ALL),
best AS (
  SELECT *, row_number() OVER (PARTITION BY size, content_key ORDER BY coalesce(accuracy, 999), ord) AS rn FROM {src}),
merged AS (
  SELECT b.size, b.content_key, min(b.first) AS group_ord, sum(b.n) > 1 AS merged, count(*) AS n_files,
         list(b.album ORDER BY b.first) AS albums, list(b.path ORDER BY b.first) AS paths
  FROM by_album b GROUP BY b.size, b.content_key),
records AS (
  SELECT m.*, t.epoch, t.accuracy,
         CASE WHEN m.merged THEN min(m.group_ord) OVER (PARTITION BY m.size) ELSE m.group_ord END AS size_ord
  FROM merged m JOIN best t ON m.size = t.size AND m.content_key = t.content_key AND t.rn = 1)"""

RECORDS = DATED + "," + MERGED.format(src="dated")

ENDINGS = """
names AS (
  SELECT doc_id, 'IMG_' || doc_id || CASE doc_id % 5 WHEN 0 THEN '-EDITED' WHEN 1 THEN '-bearbeitet' WHEN 2 THEN '-edited(1)' WHEN 3 THEN '-modifié' ELSE '' END || '.jpg' AS name
  FROM documents),
marked AS (
  SELECT *, regexp_matches(nfc_normalize(lower(regexp_replace(name, '[.][^.]*$', ''))), '(""" + "|".join(EXTRA_SUFFIXES) + """)$') AS extra FROM names)"""

FOLDERS = """
folders AS (
  SELECT DISTINCT '/in/p' || (o_orderkey % 40) AS parent,
         CASE WHEN o_orderkey % 40 < 20 AND o_orderkey % 7 = 0 THEN 'Photos from ' || year(o_orderdate)
              WHEN o_orderkey % 7 = 1 THEN 'Photos from ' || o_orderkey ELSE 'trip ' || (o_orderkey % 100) END AS name
  FROM orders),
sorted AS (SELECT parent || '/' || name AS path, parent, name, regexp_full_match(name, 'Photos from (18|19|20)[0-9][0-9]') AS is_year FROM folders),
albums AS (SELECT path, parent, name FROM sorted WHERE NOT is_year AND parent IN (SELECT parent FROM sorted WHERE is_year))"""

AWKWARD = """
names AS (
  SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN 'img_(' || (doc_id % 90) || ').(trip).lol(' || (doc_id % 90) || ').jpg'
    WHEN 1 THEN 'photo' || doc_id || '-edited(1).jpg'
    WHEN 2 THEN 'Screenshot_of_a_rather_long_name_that_goes_on_' || doc_id || '.jpg'
    ELSE 'p' || doc_id || '-mix.jpg' END AS name
  FROM documents)"""

CANDIDATES = f"""{AWKWARD},
tries AS (
  SELECT doc_id, name AS n0, left(name, 46) AS n1,
    CASE WHEN doc_id % 4 = 0 THEN 'img_(' || (doc_id % 90) || ').(trip).lol.jpg(' || (doc_id % 90) || ')' WHEN doc_id % 4 = 1 THEN 'photo' || doc_id || '-edited.jpg(1)' ELSE name END AS n2,
    replace(replace(name, '-edited', ''), '-mix', '') AS n3,
    left(name, length(name) - 4) AS n4,
    replace(replace(name, '-edited(1)', ''), '-mix', '') AS n5,
    regexp_replace(name, '[(][0-9][)][.]', '.', 'g') AS n6
  FROM names)"""

EVENT_NAMES = "events_named AS (SELECT event_id, ts, date_trunc('second', ts) AS second FROM events)"


#: The files that the file queries write, by customer: key, kind of date, folder, name, bytes, and the date there.
PICTURES = f"""
days AS (
  SELECT c_custkey AS key, c_custkey % 5 AS kind, TIMESTAMP '2010-01-01 12:00:00' + to_days(CAST(c_custkey AS INTEGER)) AS day,
         CASE WHEN c_custkey % 4 = 3 THEN 'Trip ' || (c_nationkey % 5) END AS album, 'Photos from ' || (2000 + c_nationkey) AS year_folder
  FROM customer),
pictures AS (
  SELECT key, kind, album, coalesce(album, year_folder) AS folder,
         CASE WHEN kind = 3 THEN 'IMG_' || strftime(day, '%Y%m%d_%H%M%S') || '_' || key || '.jpg' ELSE 'IMG_' || key || '.jpg' END AS name,
         CASE WHEN kind = 2 THEN from_hex('{JPEG_HEAD.hex()}') || encode(strftime(day, '%Y:%m:%d %H:%M:%S')) || from_hex('{JPEG_TAIL.hex()}')
              ELSE encode('picture ' || lpad(CAST(CASE WHEN key % 6 = 1 AND kind <> 3 THEN key - 1 ELSE key END AS VARCHAR), 7, '0')) END AS data,
         CASE WHEN kind < 2 THEN CAST(1400000000 + key * 86400 AS BIGINT) WHEN kind < 4 THEN CAST(epoch(day) AS BIGINT) END AS epoch,
         CASE WHEN kind < 2 THEN 0 WHEN kind = 2 THEN 1 WHEN kind = 3 THEN 2 END AS accuracy
  FROM days),
sizes AS (SELECT *, folder || '/' || name AS path, CAST(octet_length(data) AS BIGINT) AS size FROM pictures),
keyed AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY size) = 1 THEN size || 'bytes' ELSE sha256(data) END AS content_key,
         row_number() OVER (ORDER BY album IS NOT NULL, folder, name) AS ord
  FROM sizes)"""

#: What is left of them after duplicates, as records.
PICTURE_RECORDS = (
    PICTURES
    + """,
dated AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY album, size, content_key ORDER BY '999' || length(name), ord) AS rn FROM keyed) WHERE rn = 1),"""
    + MERGED.format(src="dated")
)


def _folder(date: str, album: str) -> str:
    return f"'/out/' || coalesce({album}, 'ALL_PHOTOS') || CASE WHEN {date} IS NULL THEN '/date-unknown' ELSE '/' || strftime(to_timestamp({date}) AT TIME ZONE 'UTC', '%Y/%m') END"


def _manifest(mode: str, records: str = RECORDS) -> str:
    """All names differ in the media view, so no name is ever taken."""
    base = f"WITH {records}, files AS (SELECT group_ord, epoch, unnest(albums) AS album, unnest(paths) AS path, list_position(list_transform(albums, lambda a: a IS NULL), true) AS main_at, paths FROM records)"
    dest = f"{_folder('epoch', 'album')} || '/' || string_split(path, '/')[-1]"
    if mode == "json":
        return f"WITH {records} SELECT 'move' AS op, paths[1] AS src, {_folder('epoch', 'NULL')} || '/' || string_split(paths[1], '/')[-1] AS dest, CAST(NULL AS VARCHAR) AS link_target, epoch AS mtime_epoch FROM records"
    if mode == "nothing":
        return f"{base} SELECT 'move' AS op, path AS src, {dest} AS dest, CAST(NULL AS VARCHAR) AS link_target, epoch AS mtime_epoch FROM files WHERE album IS NULL"
    if mode == "duplicate-copy":
        return f"{base} SELECT 'move' AS op, path AS src, {dest} AS dest, CAST(NULL AS VARCHAR) AS link_target, epoch AS mtime_epoch FROM files"
    link = "album IS NOT NULL AND main_at IS NOT NULL AND main_at > 0"
    main = "string_split(paths[main_at], '/')[-1]"
    return f"""{base} SELECT CASE WHEN {link} THEN 'link' ELSE 'move' END AS op, path AS src,
      {_folder('epoch', 'album')} || '/' || CASE WHEN {link} THEN {main} ELSE string_split(path, '/')[-1] END AS dest,
      CASE WHEN {link} THEN {_folder('epoch', 'NULL')} || '/' || {main} END AS link_target, epoch AS mtime_epoch FROM files"""


def oracle_sql() -> dict[str, str]:
    count = f"WITH {RECORDS} SELECT CAST({{}} AS BIGINT) AS files FROM records"
    found = {
        "dedup_within_album": f"WITH {SURVIVORS} SELECT ord, album, name, size, content_key FROM survivors",
        "count_duplicates": f"WITH {SURVIVORS} SELECT (SELECT count(*) FROM keyed) - (SELECT count(*) FROM survivors) AS removed",
        "group_identical": f"WITH {MEDIA} SELECT size, content_key, count(*) AS n, min(ord) AS first_ord FROM keyed GROUP BY ALL",
        "merge_albums": f"WITH {RECORDS} SELECT group_ord, size_ord, merged, size, content_key, CAST(n_files AS INTEGER) AS n_files, array_to_string(list_transform(albums, lambda a: coalesce(a, '~')), ',') AS albums, paths[1] AS first_path, epoch AS date_epoch, accuracy FROM records",
        "remove_extras": f"WITH {ENDINGS} SELECT doc_id, name FROM marked WHERE NOT extra",
        "count_extras": f"WITH {ENDINGS} SELECT count(*) FILTER (extra) AS removed FROM marked",
        "media_filter": """
            SELECT page_id, 'f' || page_id || ending AS name, ending IN ('.jpg', '.tar.HEIC') AS image
            FROM (SELECT page_id, ['.jpg', '.MP4', '.3gp', '.json', '.txt', '.mts', '', '.tar.HEIC'][page_id % 8 + 1] AS ending FROM pages)
            WHERE ending IN ('.jpg', '.MP4', '.3gp', '.mts', '.tar.HEIC')""",
        "year_folder": f"WITH {FOLDERS} SELECT path, parent, name FROM sorted WHERE is_year",
        "album_folder": f"WITH {FOLDERS} SELECT * FROM albums",
        "media_list": f"WITH {FOLDERS} SELECT CAST(NULL AS VARCHAR) AS album, path || '/a.jpg' AS path, path AS parent, 'a.jpg' AS name, CAST(1 AS BIGINT) AS size FROM sorted WHERE is_year UNION ALL SELECT name, path || '/a.jpg', path, 'a.jpg', 1 FROM albums",
        "sidecar_epoch": "SELECT event_id, CASE WHEN event_id % 5 < 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS epoch FROM events",
        "guess_date": f"WITH {EVENT_NAMES} SELECT event_id, second AS taken FROM events_named",
        "guess_date_all_patterns": f"WITH {EVENT_NAMES} SELECT event_id, second AS taken FROM events_named",
        "sidecar_candidates": f"WITH {CANDIDATES} SELECT * FROM tries",
        "sidecar_join": f"""WITH {CANDIDATES},
            placed AS (SELECT *, '/in/' || (doc_id % 17) AS parent FROM tries),
            there AS (SELECT parent || '/' || n4 || '.json' AS path FROM placed WHERE doc_id % 3 = 0 UNION SELECT parent || '/' || n0 || '.json' FROM placed WHERE doc_id % 4 = 0),
            tried AS (SELECT doc_id, unnest([n0, n1, n2, n3, n4]) AS n, unnest(range(5)) AS k, parent FROM placed),
            hits AS (SELECT doc_id, arg_min(t.path, k) AS sidecar FROM tried JOIN there t ON t.path = parent || '/' || n || '.json' GROUP BY doc_id)
            SELECT placed.doc_id, sidecar FROM placed LEFT JOIN hits USING (doc_id)""",
        "file_scan": f"""WITH {PICTURES}
            SELECT path, name, false AS is_dir, size AS length FROM keyed
            UNION ALL SELECT path || '.json', name || '.json', false, CAST(length('{{"photoTakenTime": {{"timestamp": }}}}') + CASE kind WHEN 0 THEN 12 ELSE 10 END AS BIGINT) FROM keyed WHERE kind < 2
            UNION ALL SELECT DISTINCT folder, folder, true, CAST(0 AS BIGINT) FROM keyed""",
        "file_digests": f"WITH {PICTURES} SELECT path, album, size, content_key FROM keyed",
        "file_dates": f"WITH {PICTURES} SELECT path, epoch AS date_epoch, accuracy FROM keyed",
        "file_fix": f'WITH {PICTURES} SELECT count(epoch) AS "set", count(*) - count(epoch) AS not_set FROM keyed',
        "file_organise": f"""SELECT dest, op = 'link' AS is_link, size, mtime_epoch FROM ({_manifest('shortcut', PICTURE_RECORDS)}) m JOIN
            (WITH {PICTURES} SELECT path, size FROM keyed) k ON k.path = m.src""",
        "collision_names": """
            WITH RECURSIVE named AS (
              SELECT doc_id, doc_id % 3 AS folder, doc_id % 50 AS root, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS level,
                     row_number() OVER (PARTITION BY doc_id % 3, doc_id % 50 ORDER BY doc_id) AS turn FROM documents),
            taken AS (SELECT n_nationkey % 3 AS folder, n_nationkey AS root, [0] AS levels FROM nation),
            placed AS (
              SELECT g.folder, g.root, CAST(0 AS BIGINT) AS turn, coalesce(t.levels, []) AS levels, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS INTEGER) AS level
              FROM (SELECT DISTINCT folder, root FROM named) g LEFT JOIN taken t ON t.folder = g.folder AND t.root = g.root
              UNION ALL
              SELECT folder, root, turn, list_append(levels, level), doc_id, level FROM (
                SELECT p.folder, p.root, n.turn, p.levels, n.doc_id, CAST(list_min(list_filter(range(n.level, n.level + len(p.levels) + 1), lambda x: NOT list_contains(p.levels, x))) AS INTEGER) AS level
                FROM placed p JOIN named n ON n.folder = p.folder AND n.root = p.root AND n.turn = p.turn + 1))
            SELECT doc_id, 'a' || root || repeat('(1)', level) || '.jpg' AS final_name FROM placed WHERE doc_id IS NOT NULL""",
        "date_chain": """SELECT event_id,
            CASE WHEN event_id % 2 = 0 THEN ts WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 DAY WHEN event_id % 5 = 0 THEN date_trunc('second', ts) END AS taken,
            CASE WHEN event_id % 2 = 0 THEN 0 WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 5 = 0 THEN 2 END AS accuracy FROM events""",
        "exif_dates": """SELECT o_orderkey,
            CASE WHEN o_orderkey % 4 = 3 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 01:02' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS normal,
            CASE WHEN o_orderkey % 4 = 3 THEN date_trunc('day', o_orderdate) + INTERVAL 62 MINUTE ELSE date_trunc('second', o_orderdate) END AS taken FROM orders""",
        "destination_folder": """SELECT o_orderkey, home || CASE WHEN d IS NULL THEN '/date-unknown' ELSE strftime(d, '/%Y/%m') END AS by_month, home || CASE WHEN d IS NULL THEN '/date-unknown' ELSE '' END AS flat
            FROM (SELECT o_orderkey, 'out/' || CASE WHEN o_orderkey % 3 = 0 THEN 'album ' || (o_orderkey % 10) ELSE 'ALL_PHOTOS' END AS home, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS d FROM orders)""",
        "albums_index": f"WITH {RECORDS} SELECT string_split(paths[1], '/')[-1] AS name, array_to_string(list_filter(albums, lambda a: a IS NOT NULL), ',') AS albums FROM records",
        "undated_media": f"WITH {DATED} SELECT ord, name FROM dated WHERE epoch IS NULL",
        "summary": f"""WITH {DATED}, kept AS (SELECT * FROM dated WHERE name NOT LIKE '%-edited.jpg'), {MERGED.format(src='kept')}
            SELECT (SELECT count(*) FROM keyed) - (SELECT count(*) FROM dated) AS duplicates, (SELECT count(*) FROM dated) - (SELECT count(*) FROM kept) AS extras,
                   (SELECT count(*) FROM records) AS media, (SELECT count(*) FROM records WHERE epoch IS NULL) AS undated""",
        "path_functions": f"""WITH {AWKWARD} SELECT doc_id, name AS base, '/in/x.y' AS dir, left(name, length(name) - 4) AS stem, '.jpg' AS ext,
            regexp_replace(name, 'o([^o]*)$', '_\\1') AS last_o,
            CASE WHEN doc_id * 262144 < 1024 THEN (doc_id * 262144) || ' B' WHEN doc_id * 262144 < 1048576 THEN printf('%.2f KiB', doc_id * 262144 / 1024.0) WHEN doc_id * 262144 < 1073741824 THEN printf('%.2f MiB', doc_id * 262144 / 1048576.0) ELSE printf('%.2f GiB', doc_id * 262144 / 1073741824.0) END AS size FROM names""",
        "output_file_count_shortcut": count.format("sum(n_files)"),
        "output_file_count_duplicate_copy": count.format("sum(n_files)"),
        "output_file_count_json": count.format("count(*)"),
        "output_file_count_nothing": count.format("count(*) FILTER (len(list_filter(albums, lambda a: a IS NULL)) > 0)"),
    }
    return found | {f"manifest_{m.replace('-', '_')}": _manifest(m) for m in ("shortcut", "duplicate-copy", "json", "nothing")}
