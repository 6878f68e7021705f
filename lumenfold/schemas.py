"""Schemas of the tables that stages exchange. None is ever inferred."""

FS_ENTRIES = "path string, parent string, name string, is_dir boolean, length bigint, mtime timestamp"
#: ``album`` is null for files of year folders; ``ord`` gives the list order, not a dense number.
MEDIA = "ord bigint, album string, path string, parent string, name string, size bigint"
FILE = "struct<ord:bigint,album:string,path:string>"
#: A merged record: its files in order of first appearance, one an album.
MERGED = f"size bigint, content_key string, files array<{FILE}>, date_taken timestamp, accuracy int, merged boolean, size_ord bigint, group_ord bigint"
MANIFEST = "op string, src string, dest string, link_target string, mtime timestamp, media_order struct<merged:boolean,size_ord:bigint,group_ord:bigint>, album string"
