"""Sign-text functions as native columns (no Python per row)."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# Word lists and patterns below are data of the method: results only match if
# they are exactly these.
PLACEHOLDERS = [
    "ROTULO NO INFORMADO", "NO INFORMADO", "SIN ROTULO", "NO SOLICITADO",
    "MUESTRA CORPORATIVA", "NO CONSTA", "SIN NOMBRE", "PENDIENTE", "SIN DATOS",
    "DESCONOCIDO", "NO PROCEDE", "SIN ACTIVIDAD", "POR DETERMINAR", "SR", "S R",
    "EN TRAMITE", "LOCAL VACIO", "SIN INDICAR", "MUESTRA OPACA", "MUESTRA CIEGA",
]
PLACEHOLDER_PATTERN = (
    "MUESTRA|ROTULO|SIN INDICAR|SIN ACTIVIDAD|SIN DATOS|SIN NOMBRE|"
    "OPAC|POR DETERMINAR|NO INFORMAD|NO SOLICITAD|NO CONSTA|NO PROCEDE|"
    "PENDIENTE|DESCONOCID|EN TRAMITE|LOCAL VACIO|IMPLANTA|"
    "SIN DETERMINAR|SIN DEFINIR|SIN ESPECIFICAR|SIN RATULO|SIN R0TULO"
)
GENERIC_WORDS = [
    # hospitality
    "BAR", "CAFE", "CAFETERIA", "RESTAURANTE", "RESTAURACION", "TABERNA", "MESON",
    "PIZZERIA", "CERVECERIA", "GASTROBAR", "TERRAZA", "COCINA", "COMIDAS", "BEBIDAS",
    "TAPAS", "MARISQUERIA", "HAMBURGUESERIA",
    # food retail
    "PANADERIA", "PASTELERIA", "CARNICERIA", "PESCADERIA", "FRUTERIA", "FRUTAS",
    "VERDURAS", "ALIMENTACION", "SUPERMERCADO", "CHARCUTERIA", "HERBOLARIO", "BODEGA",
    "ULTRAMARINOS",
    # retail
    "TIENDA", "COMERCIO", "ZAPATERIA", "LIBRERIA", "PAPELERIA", "JOYERIA",
    "FLORISTERIA", "FERRETERIA", "PERFUMERIA", "OPTICA", "ESTANCO", "MERCHANDISING",
    "MODA", "ROPA", "REGALOS", "BAZAR",
    # services
    "PELUQUERIA", "SALON", "BELLEZA", "ESTETICA", "BARBERIA", "SPA", "CENTRO",
    "CLINICA", "FARMACIA", "GIMNASIO", "ACADEMIA", "GUARDERIA", "INMOBILIARIA",
    "AGENCIA", "TALLER", "GARAJE", "PARKING", "HOTEL", "HOSTAL", "ADMINISTRACION",
    "LOTERIA", "ASESORIA", "GESTORIA", "LAVANDERIA", "TINTORERIA", "COPISTERIA",
    "LOCUTORIO", "FISIOTERAPIA", "SERVICIOS", "SERVICIO", "DENTAL", "FRUTOS", "SECOS",
    "MUEBLES", "DECORACION", "VETERINARIO", "VETERINARIA", "CONSULTORIO", "TABACOS",
    "MENOR", "MAYOR", "ALIMENTACIONES", "PRODUCTOS", "ARTICULOS",
    # articles, connectors and company forms
    "DE", "DEL", "LA", "EL", "LOS", "LAS", "Y", "EN", "AL", "A", "SIN", "CON", "POR",
    "PARA", "SL", "SA", "CB", "SLU", "SC",
]
LEGAL_FORMS = r"\b(S\s*L\s*U|S\s*L|S\s*A\s*U|S\s*A|C\s*B|S\s*C)\b"
LEGAL_FORMS_FIRST_VERSION = r"\b(S\s*L\s*U|S\s*L|S\s*A\s*U|S\s*A|C\s*B|S\s*C|SOCIEDAD LIMITADA|SOCIEDAD ANONIMA)\b"
MOJIBAKE = "Ã|Â|â€|Ãƒ|ï¿½"
DIGIT_IN_WORD = "[A-Z][0-9][A-Z]"
# -----------------------------------------------------------------------------

_NON_WORD = r"[^\p{L}\p{N}_]+"


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Compatibility decomposition as a ``translate`` pair, built from Unicode.

    Keeps the characters whose decomposition, without combining marks, is one
    character; lone combining marks are mapped to nothing.
    """
    source, target, removed = [], [], []
    for cp in [*range(0x80, 0x2E80), *range(0xFF00, 0xFFF0)]:
        ch = chr(cp)
        if unicodedata.combining(ch):
            removed.append(ch)
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != ch:
            source.append(ch)
            target.append(plain)
    return "".join(source) + "".join(removed), "".join(target)


VOCABULARY_BOUND = 20_000


def fold(col: Column | str) -> Column:
    """Upper case, no accents: the form used to search."""
    c = F.upper(F.trim(F.col(col) if isinstance(col, str) else col))
    plain = c
    for ch, text in (("¼", "1 4"), ("½", "1 2"), ("¾", "3 4"), ("™", "TM"), ("№", "No")):
        plain = F.replace(plain, F.lit(ch), F.lit(text))
    # most labels are plain ASCII and skip the table
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(plain, *_fold_table())).otherwise(c)


def search_fold(col: Column | str) -> Column:
    return F.coalesce(fold(col), F.lit(""))


def fix_digits(words: Column) -> Column:
    """0 -> O and 1 -> I inside tokens that hold a letter; numbers stay.

    On a single-spaced string, without splitting it: first the digits with a
    letter further on in their token, then those after a letter.
    """
    out = words
    for digit, letter in (("0", "O"), ("1", "I")):
        out = F.regexp_replace(out, digit + r"(?=[^ ]*\p{L})", letter)
        # from a letter, or from the end of the previous hit, up to the next digit
        out = F.regexp_replace(out, rf"(\p{{L}}[^ {digit}]*|\G(?!^)[^ {digit}]*){digit}", "$1" + letter)
    return F.when(words.rlike("[01]"), out).otherwise(words)


def strip_legal_forms(col: Column, pattern: str = LEGAL_FORMS) -> Column:
    return F.regexp_replace(col, "(?U)" + pattern, " ")


def _finish(folded: Column, pattern: str, digits: bool) -> Column:
    words = strip_legal_forms(F.regexp_replace(folded, _NON_WORD, " "), pattern)
    words = F.trim(F.regexp_replace(words, " +", " "))
    if digits:
        words = fix_digits(words)
    return F.coalesce(words, F.lit(""))


def normalise(col: Column | str, digits: bool = True, legal_forms: str = LEGAL_FORMS) -> Column:
    """Canonical label: folded, no punctuation, no company forms, digits fixed."""
    return _finish(fold(col), legal_forms, digits)


@F.pandas_udf(T.StringType())
def _exact_fold(s: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        decomposed = unicodedata.normalize("NFKD", text.upper().strip())
        return "".join(c for c in decomposed if not unicodedata.combining(c))

    return s.map(one)


def normalise_exact(col: Column | str, digits: bool = True) -> Column:
    """Same, with the full Unicode decomposition (Arrow batches).

    For registries whose text leaves the alphabets of ``fold``.
    """
    c = F.col(col) if isinstance(col, str) else col
    return _finish(_exact_fold(c), LEGAL_FORMS, digits)


def is_placeholder(norm: Column | str) -> Column:
    n = F.col(norm) if isinstance(norm, str) else norm
    return (n == "") | n.isin(PLACEHOLDERS) | n.rlike(PLACEHOLDER_PATTERN)


def vocabulary_words(vocabulary: DataFrame) -> list[str]:
    """Words of a nomenclature ``(word)``, as constants for the functions below.

    A nomenclature is a closed list; more than ``VOCABULARY_BOUND`` words are
    refused, because they belong in a join: see ``with_core_tokens``.
    """
    words = [r[0] for r in vocabulary.select("word").distinct().limit(VOCABULARY_BOUND + 1).collect()]
    if len(words) > VOCABULARY_BOUND:
        raise ValueError(f"more than {VOCABULARY_BOUND} words: use with_core_tokens")
    return sorted(words)


def _plain_tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda t: (F.length(t) > 1) & ~t.rlike(r"^\p{Nd}+$"))


def core_tokens(norm: Column | str, vocabulary: Sequence[str] | None = None) -> Column:
    """Distinct words of a label that do not just describe its activity.

    The words to leave out are constants: one set, built once per task.
    """
    n = F.col(norm) if isinstance(norm, str) else norm
    generic = sorted({*GENERIC_WORDS, *(vocabulary or ())})
    return F.array_distinct(F.filter(_plain_tokens(n), lambda t: ~t.isin(generic)))


def with_core_tokens(df: DataFrame, norm: str, vocabulary: DataFrame, out: str = "core") -> DataFrame:
    """``core_tokens`` against a vocabulary of any size, a table ``(word)``.

    The words of the distinct labels meet the vocabulary in an anti join, so a
    label is judged once however many rows carry it.  Tokens come sorted.
    """
    labels = df.select(F.col(norm).alias("_norm")).where(F.col("_norm").isNotNull()).distinct()
    words = labels.select("_norm", F.explode(_plain_tokens(F.col("_norm"))).alias("word")).where(~F.col("word").isin(list(GENERIC_WORDS)))
    kept = words.join(vocabulary.select("word").distinct(), "word", "left_anti")
    cores = kept.groupBy("_norm").agg(F.sort_array(F.collect_set("word")).alias("_core"))
    empty = F.array().cast("array<string>")
    return df.join(cores, df[norm] == cores["_norm"], "left").select(*df.columns, F.coalesce("_core", empty).alias(out))


def is_generic(norm: Column | str, vocabulary: Sequence[str] | None = None) -> Column:
    return F.size(core_tokens(norm, vocabulary)) == 0


def core_key(norm: Column | str, vocabulary: Sequence[str] | None = None) -> Column:
    """Canonical brand key; empty when the label is generic."""
    return F.array_join(F.sort_array(core_tokens(norm, vocabulary)), "|")


def word_count(norm: Column | str) -> Column:
    n = F.coalesce(F.col(norm) if isinstance(norm, str) else norm, F.lit(""))
    return F.size(F.filter(F.split(n, r"\s+"), lambda t: t != ""))


def raw_length(label: Column | str) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return F.coalesce(F.length(c), F.lit(0))


def strip_punctuation(col: Column | str) -> Column:
    """Older cleaner: lower case and punctuation deleted (not spaced)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""))


def is_mojibake(label: Column | str) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return F.coalesce(c.rlike(MOJIBAKE), F.lit(False))


def has_digit_in_word(folded: Column) -> Column:
    return F.coalesce(folded.rlike(DIGIT_IN_WORD), F.lit(False))


def match_key(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.upper(F.trim(c))


def match_key_no_zeros(col: Column | str) -> Column:
    """Match key without leading zeros; an all-zero code keeps one."""
    k = match_key(col)
    return F.when(k.isNull(), None).otherwise(
        F.coalesce(F.nullif(F.ltrim(k, F.lit("0")), F.lit("")), F.lit("0"))
    )


def place_name(barrio: Column | str, district: Column | str) -> Column:
    b = F.initcap(F.trim(F.col(barrio) if isinstance(barrio, str) else barrio))
    d = F.initcap(F.trim(F.col(district) if isinstance(district, str) else district))
    return F.concat(b, F.lit(" ("), d, F.lit(")"))


