"""The suras and verse numbering: a fixed table, and arithmetic on it."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

#: Verses of each sura, in order.
VERSES = [
    7, 286, 200, 176, 120, 165, 206, 75, 129, 109, 123, 111, 43, 52, 99, 128, 111, 110, 98, 135, 112, 78, 118, 64, 77, 227, 93, 88, 69, 60,
    34, 30, 73, 54, 45, 83, 182, 88, 75, 85, 54, 53, 89, 59, 37, 35, 38, 29, 18, 45, 60, 49, 62, 55, 78, 96, 29, 22, 24, 13,
    14, 11, 11, 18, 12, 12, 30, 52, 52, 44, 28, 28, 20, 56, 40, 31, 50, 40, 46, 42, 29, 19, 36, 25, 22, 17, 19, 26, 30, 20,
    15, 21, 11, 8, 8, 19, 5, 8, 8, 11, 11, 8, 3, 9, 5, 4, 7, 3, 6, 3, 5, 4, 5, 6,
]
#: Names of the suras, in order.
NAMES = [
    "الفاتحة", "البقرة", "آل عمران", "النساء", "المائدة", "الأنعام", "الأعراف", "الأنفال", "التوبة", "يونس", "هود", "يوسف",
    "الرعد", "إبراهيم", "الحجر", "النحل", "الإسراء", "الكهف", "مريم", "طه", "الأنبياء", "الحج", "المؤمنون", "النور",
    "الفرقان", "الشعراء", "النمل", "القصص", "العنكبوت", "الروم", "لقمان", "السجدة", "الأحزاب", "سبأ", "فاطر", "يس",
    "الصافات", "ص", "الزمر", "غافر", "فصلت", "الشورى", "الزخرف", "الدخان", "الجاثية", "الأحقاف", "محمد", "الفتح",
    "الحجرات", "ق", "الذاريات", "الطور", "النجم", "القمر", "الرحمن", "الواقعة", "الحديد", "المجادلة", "الحشر", "الممتحنة",
    "الصف", "الجمعة", "المنافقون", "التغابن", "الطلاق", "التحريم", "الملك", "القلم", "الحاقة", "المعارج", "نوح", "الجن",
    "المزمل", "المدثر", "القيامة", "الإنسان", "المرسلات", "النبأ", "النازعات", "عبس", "التكوير", "الانفطار", "المطففين", "الانشقاق",
    "البروج", "الطارق", "الأعلى", "الغاشية", "الفجر", "البلد", "الشمس", "الليل", "الضحى", "الشرح", "التين", "العلق",
    "القدر", "البينة", "الزلزلة", "العاديات", "القارعة", "التكاثر", "العصر", "الهمزة", "الفيل", "قريش", "الماعون", "الكوثر",
    "الكافرون", "النصر", "المسد", "الإخلاص", "الفلق", "الناس",
]
LAST = list(accumulate(VERSES))
TOTAL = LAST[-1]


def aya_id(sura: int, verse: int) -> int | None:
    """Running number of a verse; null out of range."""
    return LAST[sura - 1] - VERSES[sura - 1] + verse if 1 <= sura <= len(VERSES) and 1 <= verse <= VERSES[sura - 1] else None


def sura_and_verse(number: int) -> tuple[int, int] | None:
    """(sura, verse) of a running number; null out of range."""
    if not 1 <= number <= TOTAL:
        return None
    sura = next(i for i, last in enumerate(LAST) if number <= last)
    return sura + 1, number - LAST[sura] + VERSES[sura]


def sura_dim(spark: SparkSession) -> DataFrame:
    """114 rows: surah, surah_name, ayat, end_aya_id."""
    return spark.createDataFrame([(i + 1, n, v, e) for i, (n, v, e) in enumerate(zip(NAMES, VERSES, LAST))], "surah int, surah_name string, ayat int, end_aya_id int")


def aya_dim(spark: SparkSession) -> DataFrame:
    """6,236 rows: aya_id, surah, surah_name, aya. An equality key instead of a range join."""
    return sura_dim(spark).selectExpr("explode(sequence(end_aya_id - ayat + 1, end_aya_id)) as aya_id", "surah", "surah_name", "ayat", "end_aya_id").selectExpr("aya_id", "surah", "surah_name", "aya_id - end_aya_id + ayat as aya")
