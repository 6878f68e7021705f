"""Driver queries: each operator over media views that are made from the test tables' columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import file_queries
from lumenfold.functions import dates, paths, sidecar_names
from lumenfold.functions.mime import is_image, is_media
from lumenfold.operators import albums, classify, content, dedup, extras
from lumenfold.operators.dates import resolve_dates, undated
from lumenfold.operators.sidecar import find_sidecars
from lumenfold.options import ALBUM_MODES, Options
from lumenfold.plans import manifest, naming

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts: Column | str) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


# ---------------------------------------------------------------- media views


def documents_as_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a file; every second one is in the album of its source."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    name = text("IMG_", i, F.when(i % 5 == 0, "-edited").otherwise(""), ".jpg")
    return docs.select(i.alias("ord"), F.when(i % 2 == 1, F.col("source")).alias("album"), text("/in/", name).alias("path"), name.alias("name"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("hash"))


def keyed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.with_content_key(documents_as_media(spark, sf_dir), F.col("hash"))


def dated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors with dates by id: every third undated, accuracies 0 to 3."""
    i = F.col("ord")
    day = F.timestamp_seconds(F.lit(1_500_000_000) + i * 86_413)
    rows = dedup.remove_duplicates(keyed_documents(spark, sf_dir))
    return rows.withColumn("date_taken", F.when(i % 3 != 0, day)).withColumn("accuracy", F.when(i % 3 != 0, (i % 4).cast("int")))


def merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return albums.merge_albums(dated_documents(spark, sf_dir))


def events_as_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a file named by its time, in one of six shapes."""
    events, i, ts = table(spark, sf_dir, "events"), F.col("event_id"), F.col("ts")
    shapes = ("yyyyMMdd-HHmmss", "yyyyMMdd_HHmmss", "yyyy-MM-dd-HH-mm-ss", "yyyy-MM-dd-HHmmss", "yyyyMMddHHmmss", "yyyy_MM_dd_HH_mm_ss")
    stamp = F.date_format(ts, shapes[-1])
    for k, s in enumerate(shapes[:-1]):
        stamp = F.when(i % 6 == k, F.date_format(ts, s)).otherwise(stamp)
    return events.select("event_id", "ts", "props", text("IMG_", F.date_format(ts, "yyyyMMdd_HHmmss"), ".jpg").alias("name"), text("IMG_", stamp, ".jpg").alias("shaped"))


# ---------------------------------------------------------------- queries


def dedup_within_album(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.remove_duplicates(keyed_documents(spark, sf_dir)).select("ord", "album", "name", "size", "content_key")


def count_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.count_duplicates(keyed_documents(spark, sf_dir))


def group_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.group_identical(keyed_documents(spark, sf_dir))


def merge_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merged_documents(spark, sf_dir)
    return m.select("group_ord", "size_ord", "merged", "size", "content_key", F.size("files").alias("n_files"), F.array_join(F.transform("files", lambda f: F.coalesce(f["album"], F.lit("~"))), ",").alias("albums"), F.element_at("files", 1)["path"].alias("first_path"), F.unix_timestamp("date_taken").alias("date_epoch"), "accuracy")


def remove_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.remove_extras(_names_with_extras(spark, sf_dir)).select("doc_id", "name")


def count_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.count_extras(_names_with_extras(spark, sf_dir))


def _names_with_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    ending = F.when(i % 5 == 0, "-EDITED").when(i % 5 == 1, "-bearbeitet").when(i % 5 == 2, "-edited(1)").when(i % 5 == 3, "-modifié").otherwise("")
    return table(spark, sf_dir, "documents").select(i, text("IMG_", i, ending, ".jpg").alias("name"))


def media_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    ends = (".jpg", ".MP4", ".3gp", ".json", ".txt", ".mts", "", ".tar.HEIC")
    end = F.lit(ends[-1])
    for k, e in enumerate(ends[:-1]):
        end = F.when(i % 8 == k, F.lit(e)).otherwise(end)
    rows = table(spark, sf_dir, "pages").select(i, text("f", i, end).alias("name"))
    return rows.filter(is_media(F.col("name"))).select("page_id", "name", is_image(F.col("name")).alias("image"))


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders by order key: year folders under some parents, albums and others beside them."""
    k = F.col("o_orderkey")
    parent = text("/in/p", k % 40)
    name = F.when((k % 40 < 20) & (k % 7 == 0), text("Photos from ", F.year("o_orderdate"))).when(k % 7 == 1, text("Photos from ", k)).otherwise(text("trip ", k % 100))
    return table(spark, sf_dir, "orders").select(parent.alias("parent"), name.alias("name")).distinct().select(F.concat_ws("/", "parent", "name").alias("path"), "parent", "name", F.lit(True).alias("is_dir"))


def year_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.year_folders(_folders(spark, sf_dir))


def album_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.album_folders(_folders(spark, sf_dir))


def media_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of year folders and albums, with the rank that their order gives."""
    folders = _folders(spark, sf_dir)
    files = folders.select(F.concat("path", F.lit("/a.jpg")).alias("path"), F.col("path").alias("parent"), F.lit("a.jpg").alias("name"), F.lit(False).alias("is_dir"))
    entries = folders.unionByName(files).withColumn("length", F.lit(1).cast("long"))
    return classify.media_list(entries).select("album", "path", "parent", "name", "size")


def sidecar_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sidecar path over bodies in several states: number, string, broken, array root."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k")
    body = F.when(i % 5 == 0, text('{"photoTakenTime": {"timestamp": "', k, '"}}')).when(i % 5 == 1, text('{"photoTakenTime": {"timestamp": ', k, "}}")).when(i % 5 == 2, text('{"photoTakenTime": {"timestamp": "', k, '.5"}}')).when(i % 5 == 3, text('{"photoTakenTime": ')).otherwise(text('[{"photoTakenTime": {"timestamp": ', k, "}}]"))
    return table(spark, sf_dir, "events").select("event_id", dates.sidecar_epoch(body).alias("epoch"))


def guess_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_media(spark, sf_dir).select("event_id", dates.guess_from_name(F.col("name")).alias("taken"))


def guess_date_all_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_media(spark, sf_dir).select("event_id", dates.guess_from_name(F.col("shaped")).alias("taken"))


def _awkward_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.when(i % 4 == 0, text("img_(", i % 90, ").(trip).lol(", i % 90, ").jpg")).when(i % 4 == 1, text("photo", i, "-edited(1).jpg")).when(i % 4 == 2, text("Screenshot_of_a_rather_long_name_that_goes_on_", i, ".jpg")).otherwise(text("p", i, "-mix.jpg"))
    return table(spark, sf_dir, "documents").select(i, name.alias("name"))


def sidecar_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    tries = {f"n{k}": f(n) for k, f in enumerate(sidecar_names.HARD)}
    return _awkward_names(spark, sf_dir).select("doc_id", *(c.alias(k) for k, c in tries.items()))


def sidecar_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First existing candidate: sidecars exist under the stem for ids divisible by 3, under the name for those by 4."""
    rows = _awkward_names(spark, sf_dir).withColumn("parent", text("/in/", F.col("doc_id") % 17)).withColumn("path", F.concat_ws("/", "parent", "name"))
    i = F.col("doc_id")
    short = rows.filter(i % 3 == 0).select("parent", F.concat(paths.stem(F.col("name")), F.lit(".json")).alias("name"))
    full = rows.filter(i % 4 == 0).select("parent", F.concat("name", F.lit(".json")).alias("name"))
    entries = short.unionByName(full).distinct().select(F.concat_ws("/", "parent", "name").alias("path"), "parent", "name", F.lit(False).alias("is_dir"))
    found = find_sidecars(rows, entries)
    return rows.join(found, "path", "left").select("doc_id", "sidecar")


def date_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked chain over extractors that know some ids, the last of which guesses from names."""
    i = F.col("event_id")
    media = events_as_media(spark, sf_dir).withColumn("path", i.cast("string"))

    def knows(every: int, shift: str):
        return lambda rows, _: rows.filter(i % every == 0).select("path", (F.col("ts") + F.expr(shift)).alias("date"))

    def names(rows: DataFrame, _: DataFrame) -> DataFrame:
        return rows.filter(i % 5 == 0).select("path", dates.guess_from_name(F.col("name")).alias("date"))

    dated = resolve_dates(media, media, [knows(2, "INTERVAL 0 DAY"), knows(3, "INTERVAL 1 DAY"), names])
    return dated.select("event_id", F.col("date_taken").alias("taken"), "accuracy")


def exif_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(k % 4 == 0, F.date_format(d, "yyyy:MM:dd HH:mm:ss")).when(k % 4 == 1, F.date_format(d, "yyyy/MM/dd HH.mm.ss")).when(k % 4 == 2, F.date_format(d, "yyyy-MM-dd HH:mm:ss.SSS")).otherwise(F.concat(F.date_format(d, "yyyy:MM:"), F.lpad(F.dayofmonth(d).cast("string"), 2, " "), F.lit(" 01:02")))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.normalise_exif(raw).alias("normal"), dates.parse_exif(raw).alias("taken"))


def destination_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    album = F.when(k % 3 == 0, text(" album ", k % 10, " "))
    date = F.when(k % 5 != 0, F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", manifest.destination_folder(F.lit("out"), album, date, True).alias("by_month"), manifest.destination_folder(F.lit("out"), album, date, False).alias("flat"))


def output_file_count(mode: str) -> Query:
    return lambda spark, sf_dir: albums.output_file_count(merged_documents(spark, sf_dir), mode)


def albums_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest.albums_index(manifest.build_manifest(merged_documents(spark, sf_dir), Options(output="/out", albums="json")))
    return found.select("name", F.array_join("albums", ",").alias("albums"))


def manifest_actions(mode: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = manifest.build_manifest(merged_documents(spark, sf_dir), Options(output="/out", albums=mode, divide_to_dates=True))
        return made.select("op", "src", "dest", "link_target", F.unix_timestamp("mtime").alias("mtime_epoch"))

    return query


def collision_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that collide in few folders, some carrying (1) from the start, some taken before."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(i, text("/out/", i % 3).alias("folder"), text("a", i % 50, F.when(i % 7 == 0, "(1)").otherwise(""), ".jpg").alias("name"))
    taken = table(spark, sf_dir, "nation").select(text("/out/", F.col("n_nationkey") % 3).alias("folder"), text("a", F.col("n_nationkey"), ".jpg").alias("name"))
    named = naming.assign_names(rows.withColumn("key", i.cast("string")), taken, "key", ["doc_id"])
    return named.select(F.col("key").cast("long").alias("doc_id"), "final_name")


def undated_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return undated(dated_documents(spark, sf_dir)).select("ord", "name")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.plans.organise import summary as report

    media = dated_documents(spark, sf_dir)
    return report(keyed_documents(spark, sf_dir), media, extras.remove_extras(media), albums.merge_albums(extras.remove_extras(media)))


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _awkward_names(spark, sf_dir).withColumn("path", text("/in/x.y/", F.col("name")))
    n, p = F.col("name"), F.col("path")
    return rows.select("doc_id", paths.basename(p).alias("base"), paths.dirname(p).alias("dir"), paths.stem(n).alias("stem"), paths.extension(n).alias("ext"), paths.replace_last(n, F.lit("o"), F.lit("_")).alias("last_o"), paths.human_size(F.col("doc_id") * 262144).alias("size"))


def queries() -> dict[str, Query]:
    plain = (
        dedup_within_album, count_duplicates, group_identical, merge_albums, remove_extras, count_extras, media_filter, year_folder, album_folder, media_list, sidecar_epoch, guess_date,
        guess_date_all_patterns, sidecar_candidates, sidecar_join, date_chain, exif_dates, destination_folder, albums_index, collision_names, undated_media, summary, path_functions,
    )
    found: dict[str, Query] = {f.__name__: f for f in plain}
    for mode in ALBUM_MODES:
        found[f"output_file_count_{mode.replace('-', '_')}"] = output_file_count(mode)
        found[f"manifest_{mode.replace('-', '_')}"] = manifest_actions(mode)
    return found | file_queries.queries()
