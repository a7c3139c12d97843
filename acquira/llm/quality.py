"""Quality rules, line first, in built-in functions only: lines that fail a rule go, then documents that lose too much text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rules of a line. A kept line ends as a sentence does, isn't navigation or boilerplate, isn't shouted, and few of its characters are symbols.
ENDS = "[.!?…:;\"”’»)\\]][\\x20\\x09-\\x0D]*$"
#: Of lines in lower case, in English, German, French and Spanish: menus by their separators or first word, notices, two links or more.
_GAP = "[\\x20\\x09-\\x0D]"
NAVIGATION = (
    "^[^|»›]*([|»›][^|»›]*){2,}$|^(home|menu|next|previous|back to top|login|sign in|sitemap"
    "|startseite|menü|weiter|zurück|anmelden|accueil|suivant|précédent|connexion|inicio|siguiente|anterior|iniciar sesión)(" + _GAP + "|$)"
)
BOILERPLATE = (
    "(^|" + _GAP + ")(all rights reserved|copyright|licen[sc]ed under|released under|terms of (use|service)|privacy policy|cookie|javascript|click here|subscribe now"
    "|alle rechte vorbehalten|lizenziert unter|veröffentlicht unter|nutzungsbedingungen|datenschutz|impressum|hier klicken|jetzt abonnieren"
    "|tous droits réservés|sous licence|publié sous|conditions d.utilisation|politique de confidentialité|mentions légales|cliquez ici|abonnez-vous"
    "|todos los derechos reservados|bajo (la )?licencia|publicado bajo|términos (de uso|del servicio)|política de privacidad|aviso legal|haga clic|suscríbase)"
)
LINKS = "(https?://|www[.]).*(https?://|www[.])"
UNWANTED = "|".join([NAVIGATION, BOILERPLATE, LINKS])
SHOUTED = "^[^a-zß-öø-ÿ]*[A-ZÀ-ÖØ-Þ][^a-zß-öø-ÿ]{20,}$"
MAX_SYMBOL_PERCENT = 10
#: A document stays if at least this percentage of its lines' characters stays.
MIN_KEPT_PERCENT = 50


def _symbols(c: Column) -> Column:
    return F.char_length(c) - F.char_length(F.translate(c, SYMBOLS, ""))


def line_passes(line: Column) -> Column:
    """Whether a line that has a word passes every rule."""
    return (
        line.rlike(ENDS)
        & ~F.lower(line).rlike(UNWANTED)
        & ~line.rlike(SHOUTED)
        & (_symbols(line) * 100 <= F.char_length(line) * MAX_SYMBOL_PERCENT)
    )


def with_repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in a three-word window that the row's ``words`` have more than once.

    A window's hash and its place share one long, so that one sort of longs brings equal windows together; the place takes only
    the bits that the text's length needs. Windows whose hashes meet are compared by their words.
    """
    get = lambda a, i: F.call_function("get", a, i)
    bits = F.col("place_bits")
    place = lambda x: F.call_function("shiftrightunsigned", F.call_function("shiftleft", x, 64 - bits), 64 - bits)
    window = lambda x, i: F.call_function("shiftleft", F.xxhash64(x, get(F.col("word_hash"), i + 1), get(F.col("word_hash"), i + 2)), bits).bitwiseOR(i.cast("long"))
    same = lambda x, i: F.call_function("shiftrightunsigned", x.bitwiseXOR(get(F.col("sorted_windows"), i)), bits) == 0
    df = df.withColumns({"word_hash": F.transform("words", lambda w: F.xxhash64(w)), "place_bits": F.length(F.bin(F.size("words").cast("long")))})
    df = df.withColumn("sorted_windows", F.sort_array(F.transform(F.slice("word_hash", F.lit(1), F.greatest(F.size("word_hash") - 2, F.lit(0))), window)))
    df = df.withColumn("repeated", F.filter("sorted_windows", lambda x, i: same(x, i + 1) | same(x, i - 1)))
    window_of = lambda p: F.concat_ws(" ", *[get(F.col("words"), (p + i).cast("int")) for i in range(3)])
    df = df.withColumn("met", F.sort_array(F.transform(F.transform("repeated", place), lambda p: F.struct(window_of(p).alias("w"), p.alias("p")))))
    equal = lambda x, i: x["w"] == get(F.col("met"), i)["w"]
    df = df.withColumn("places", F.sort_array(F.transform(F.filter("met", lambda x, i: equal(x, i + 1) | equal(x, i - 1)), lambda x: x["p"])))
    n = F.size("places")
    gaps = F.zip_with(F.slice("places", F.lit(1), n - 1), F.slice("places", F.lit(2), n - 1), lambda a, b: F.least(F.lit(3).cast("long"), b - a))
    total = F.aggregate(gaps, F.lit(3).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.when(n > 0, total).otherwise(F.lit(0).cast("long"))).drop("word_hash", "place_bits", "sorted_windows", "repeated", "met", "places")


def clean_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, clean_text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null or empty text has no words and fails. Repeated rows and null ids stay as they are; other columns are not carried.
    """
    df = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    df = df.withColumn("core", F.btrim(F.col("t"), F.lit(SPACES)))
    df = df.withColumn("words", F.when(F.col("core") == "", F.array().cast("array<string>")).otherwise(F.split("core", SPACE_RUN)))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    df = df.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
        "n_symbols": _symbols(F.col("t")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "line_chars": F.char_length(F.array_join("lines", "")),
        "kept_lines": F.filter("lines", line_passes),
    })
    df = df.withColumns({"clean_text": F.array_join("kept_lines", "\n"), "kept_chars": F.char_length(F.array_join("kept_lines", ""))})
    df = with_repeated_words(df)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select(
        F.col("id").alias(id_col), "clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (100 * F.col("kept_chars") >= MIN_KEPT_PERCENT * F.col("line_chars"))).alias("kept"),
    )


def oracle() -> str:
    """The digest in DuckDB's SQL."""
    esc = lambda p: p.replace("'", "''")
    sym = r"[#*$%&|<>]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
 w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
 wi AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
 rp AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM wi) WHERE c > 1),
 rw AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS j FROM rp) GROUP BY rid),
 f AS (SELECT w.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
   CAST(coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) AS BIGINT) AS line_chars,
   CAST(coalesce(list_sum(list_transform(list_filter(ls, lambda x: regexp_matches(x, '{esc(ENDS)}') AND NOT regexp_matches(lower(x), '{esc(UNWANTED)}')
     AND NOT regexp_matches(x, '{esc(SHOUTED)}')
     AND 100 * (length(x) - length(regexp_replace(x, '{sym}', '', 'g'))) <= {MAX_SYMBOL_PERCENT} * length(x)), lambda x: length(x))), 0) AS BIGINT) AS kept_chars
   FROM w LEFT JOIN rw USING (rid))
SELECT doc_id, n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(t) - length(regexp_replace(t, '{sym}', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_repeat_words,
 (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
 (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_chars >= {MIN_KEPT_PERCENT} * line_chars) AS kept
FROM f"""
