"""What a document's path tells: section, brand with its line, type by the folders' names, archive or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: folders' names and their types, extensions of tables, signs of an archive, the shapes of a line's and a category's folder
FOLDER_TYPES = {
    "КАТАЛОГ": "КАТАЛОГ", "ПРАЙС ЛИСТ": "ПРАЙС-ЛИСТ", "ПРАЙС-ЛИСТ": "ПРАЙС-ЛИСТ", "РУКОВОДСТВО": "РУКОВОДСТВО", "ПАСПОРТ": "ПАСПОРТ",
    "СЕРТИФИКАТ": "СЕРТИФИКАТ", "ДЕКЛАРАЦИИ": "СЕРТИФИКАТ", "ОПРОСНЫЙ ЛИСТ": "ОПРОСНЫЙ ЛИСТ", "РЕФЕРЕНС": "РЕФЕРЕНС", "ПРОГРАММА ПОДБОРА": "ПРОГРАММА ПОДБОРА",
    "ЧЕРТЕЖИ DWG REVIT 3D": "ЧЕРТЁЖ", "ВИДЕО ФОТОМАТЕРИАЛЫ": "МЕДИА", "1КАТАЛОГ": "КАТАЛОГ", "2ПРАЙС_ЛИСТ": "ПРАЙС-ЛИСТ", "3РУКОВОДСТВО": "РУКОВОДСТВО",
    "4ПАСПОРТ": "ПАСПОРТ", "5СЕРТИФИКАТ": "СЕРТИФИКАТ", "6ОПРОСНЫЙ ЛИСТ": "ОПРОСНЫЙ ЛИСТ", "7РЕФЕРЕНС": "РЕФЕРЕНС", "8РЕФЕРЕНС": "РЕФЕРЕНС",
    "7ПРОГРАММА ПОДБОРА": "ПРОГРАММА ПОДБОРА", "9ЧЕРТЕЖИ_DWG_REVIT_3D": "ЧЕРТЁЖ", "10ВИДЕО_ФОТОМАТЕРИАЛЫ": "МЕДИА", "ДРУГОЕ": "ДРУГОЕ", "АРХИВ": "АРХИВ", "Архив": "АРХИВ",
}
TABLE_EXTENSIONS = ("xlsx", "xlsm", "xls", "csv")
ARCHIVE_MARKERS = ("архив", "archive", "старые", "устаревш", "old", "не актуальн")
LINE_FOLDER = "^[A-ZА-Я]{2,}[_ ]"
CATEGORY_FOLDER = "^[0-9]{1,2}[А-ЯЁA-Z_][А-ЯЁA-Z_ ]{3,}$"


def path_meta(rows: DataFrame, path: str, folder_types: DataFrame) -> DataFrame:
    """``rows`` with ``section``, ``brand``, ``doc_type`` and ``is_archive`` of ``path`` (parts joined by "/").

    The type is that of the last folder behind the brand that ``folder_types``
    (name, doc_type) knows, as it stands or, for a numbered category, without its
    number; an unknown numbered category is a type of its own.  Only different
    folders are looked up, however many files they hold.
    """
    given = F.split(path, "/")
    folders = F.slice(given, 1, F.size(given) - 1)
    dirs = rows.where(F.col(path).isNotNull()).select(folders.alias("__dir")).distinct()
    key = F.btrim(F.col("part"))
    plain = F.when(key.rlike(CATEGORY_FOLDER), F.btrim(F.replace(F.regexp_replace(key, "^[0-9]+", ""), F.lit("_"), F.lit(" "))))
    categories = dirs.select("__dir", F.posexplode(F.slice("__dir", 3, 1_000_000)).alias("place", "part")).withColumns({"key": key, "plain": plain})
    types = lambda name, out: folder_types.select(F.col("name").alias(name), F.col("doc_type").alias(out))
    known = categories.join(types("key", "whole"), "key", "left").join(types("plain", "less"), "plain", "left")
    known = known.withColumn("type", F.coalesce("whole", "less", "plain")).where("type IS NOT NULL")
    typed = known.groupBy("__dir").agg(F.max_by("type", "place").alias("__type"))
    out = rows.join(typed, folders == F.col("__dir"), "left")
    part = lambda k: F.get(given, F.lit(k))
    brand = F.when(F.size(given) > 2, part(1))
    line = F.btrim(F.replace(F.regexp_replace(part(2), r"\s*\([^)]*\)\s*$", ""), F.lit("_"), F.lit(" ")))
    lined = (F.size(given) > 3) & part(2).rlike(LINE_FOLDER) & (line != "") & (F.lower(line) != F.lower(brand))
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    return out.withColumns(
        {
            "section": F.when(F.size(given) > 1, part(0)),
            "brand": F.when(lined, F.concat(brand, F.lit(" / "), line)).otherwise(brand),
            "doc_type": F.coalesce("__type", F.when(ext.isin(*TABLE_EXTENSIONS), "ТАБЛИЦА")),
            "is_archive": F.exists(folders, lambda x: F.lower(x).rlike("|".join(ARCHIVE_MARKERS))),
        }
    ).drop("__dir", "__type")
