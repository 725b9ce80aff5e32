"""Settings of the engine and its small dimension tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Status of a translation.
NOT_TRANSLATED, MACHINE_TRANSLATED, HUMAN_REVIEWED, SIMILAR = 0, 1, 2, 3
STATUS_NAMES = {0: "not_translated", 1: "machine_translated", 2: "human_reviewed", 3: "similar"}

# Contexts that page lookups leave out (SQL LIKE; _ is a wildcard).
EXCLUDED_CONTEXTS = ("media.src%", "%_seo_title", "%_meta_description", "%_og_title", "%_og_description")

# Languages written from right to left.
RTL = ("ar", "arc", "ckb", "dv", "fa", "ha", "he", "ks", "ku", "ps", "sd", "ug", "ur", "yi")

# Locale of a language where it isn't the code in both cases (de -> de_DE).
LOCALES = {"en": "en_US", "pt": "pt_BR", "zh": "zh_CN", "ja": "ja", "ko": "ko_KR", "uk": "uk", "cs": "cs_CZ", "da": "da_DK", "sv": "sv_SE", "el": "el", "ar": "ar", "he": "he_IL"}

# Country whose flag stands for a language, where it isn't the code itself.
COUNTRIES = {"en": "us", "ar": "sa", "cs": "cz", "da": "dk", "el": "gr", "et": "ee", "fa": "ir", "ga": "ie", "he": "il", "hi": "in", "ja": "jp", "ko": "kr", "sl": "si", "sr": "rs", "sv": "se", "uk": "ua", "vi": "vn", "zh": "cn"}


@dataclass(frozen=True)
class EngineConfig:
    languages: tuple[str, ...] = ("en", "fr", "de", "es")
    default: str = "en"
    home: str = ""
    min_length: int = 2
    max_length: int = 500
    source_script: str | None = None
    excluded_contexts: tuple[str, ...] = EXCLUDED_CONTEXTS
    denylist: tuple[str, ...] = field(default=())

    def targets(self) -> tuple[str, ...]:
        """The languages without the default."""
        return tuple(x for x in self.languages if x != self.default)


def locale_of(code: str) -> str:
    return LOCALES.get(code, f"{code}_{code.upper()}" if len(code) == 2 else code)


def language_table(spark: SparkSession, codes: tuple[str, ...]) -> DataFrame:
    """(lang_no, code, name, native_name, country, locale, rtl) of the given codes; names come from the JVM's locale data."""
    locale = spark.sparkContext._jvm.java.util.Locale
    rows = []
    for no, code in enumerate(codes):
        own = locale(code)
        rows.append((no, code, own.getDisplayLanguage(locale.ENGLISH), own.getDisplayLanguage(own), COUNTRIES.get(code, code), locale_of(code), code in RTL))
    return spark.createDataFrame(rows, "lang_no int, code string, name string, native_name string, country string, locale string, rtl boolean")
