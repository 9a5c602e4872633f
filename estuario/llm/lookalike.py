"""Text that looks the same but is stored with different characters, brought to one form."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..session import checkpoint

# Letters of other scripts that are drawn like a Latin letter, each with that letter.
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ү": "Y",
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z",
    "ɡ": "g", "ɑ": "a", "‐": "-", "‑": "-",
    "օ": "o", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "զ": "q", "յ": "j", "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    "Ⲃ": "B", "Ⲥ": "C", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲧ": "T", "Ⲭ": "X", "Ⲩ": "Y", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "ⲭ": "x",
}
# Single characters drawn like several, beside those of the rule in expansions().
EXPANSIONS = {"…": "...", "‥": "..", "ﬅ": "st"}
# Ranges that have no ink of their own, as in a regular expression. Joiners, style selectors and tags are seen in some places, see canonical_sql.
INVISIBLE = r"\x{00}-\x{08}\x{0E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E001F}\x{E0080}-\x{E0FFF}"
BLANK = r"\t\x{0B}\x{0C} \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{2800}\x{3000}"
LINE = r"\r\n|[\r\x{85}\x{2028}\x{2029}]"
PICTOGRAM = r"\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2190}-\x{21FF}\x{2300}-\x{27BF}\x{2900}-\x{297F}\x{2B00}-\x{2BFF}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}"
# Letters that change their shape with their neighbours (Arabic, Syriac, N'Ko), and marks that join two letters of Indic scripts into one sign.
SHAPED = r"\x{0620}-\x{065F}\x{066E}-\x{06D3}\x{06FA}-\x{06FF}\x{0710}-\x{072F}\x{0750}-\x{077F}\x{07CA}-\x{07EA}\x{08A0}-\x{08C9}"
VIRAMA = r"\x{094D}\x{09CD}\x{0A4D}\x{0ACD}\x{0B4D}\x{0BCD}\x{0C4D}\x{0CCD}\x{0D4D}\x{0DCA}\x{1039}\x{103A}\x{17D2}"
TAGS = r"\x{E0020}-\x{E007F}"
#: Stand for a joiner, a non-joiner and a text-style selector where they are seen, while the others are dropped; noncharacters, so no text can hold them.
_KEPT, _KEPT_NON, _KEPT_STYLE = "\U0010ffff", "\U0010fffe", "\U0001ffff"


@cache
def one_to_one() -> dict[str, str]:
    """Characters that become one other: width and font forms, positional forms, radicals and numerals by the rule of their Unicode
    decomposition, and the look-alikes with all their accented forms."""
    out = dict(LOOKALIKES)
    for cp in (*range(0x2160, 0x2180), *range(0x2F00, 0x2FE0), *range(0x3131, 0x318F), *range(0xFB50, 0xFF00), *range(0xFF01, 0xFFEF), *range(0x1D400, 0x1D800), *range(0x2100, 0x2150)):
        kind, _, to = unicodedata.decomposition(c := chr(cp)).rpartition("> ")
        if kind and kind not in ("<super", "<sub", "<circle", "<square", "<fraction", "<vertical") and len(n := unicodedata.normalize("NFKC", c)) == 1:
            out[c] = LOOKALIKES.get(n, n)
    for cp in (*range(0x0370, 0x0530), *range(0x1F00, 0x2000)):  # accented Greek and Cyrillic letters over a look-alike base
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and d[0] in LOOKALIKES and len(n := unicodedata.normalize("NFC", LOOKALIKES[d[0]] + d[1:])) == 1:
            out[chr(cp)] = n
    return out


@cache
def expansions() -> dict[str, str]:
    """Characters that become several: numerals, digraphs and ligatures by the rule of their Unicode decomposition, and the fixed ones."""
    out = dict(EXPANSIONS)
    for cp in (*range(0x0132, 0x0134), *range(0x01C4, 0x01CD), *range(0x01F1, 0x01F4), *range(0x2160, 0x2180), *range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18), *range(0xFEF5, 0xFEFD)):
        if len(n := unicodedata.normalize("NFKC", chr(cp))) > 1:
            out.setdefault(chr(cp), "".join(LOOKALIKES.get(c, c) for c in n))
    return out


def _ranges(chars: list[str]) -> str:
    cps, out = sorted(map(ord, chars)), ""
    while cps:
        n = 1
        while n < len(cps) and cps[n] == cps[0] + n:
            n += 1
        out += rf"\x{{{cps[0]:X}}}" + (rf"-\x{{{cps[n - 1]:X}}}" if n > 1 else "")
        cps = cps[n:]
    return out


def canonical_sql(column: str) -> str:
    """The DuckDB expression that brings ``column`` to its canonical form.

    In order: marks that are seen are kept: joiners inside pictogram sequences and where they change a letter's shape, non-joiners between
    shaped letters or after a virama, the text-style selector of a pictogram, the tags of a flag. Everything else without ink goes
    (the emoji-style selector too: a pictogram without any is read as an emoji), compatibility forms and look-alikes are mapped, accents are composed, blanks of any width and number become one space and blank ends go, line ends one kind.
    The mappings run only where a character of theirs occurs.
    """
    q = lambda s: "'" + s.replace("'", "''") + "'"
    table = one_to_one()
    t = column
    joined = t
    for _ in range(2):  # twice, as neighbouring sequences share a pictogram
        joined = rf"regexp_replace({joined}, '([{PICTOGRAM}][\x{{FE0F}}\x{{1F3FB}}-\x{{1F3FF}}]*)\x{{200D}}([{PICTOGRAM}])', '\1{_KEPT}\2', 'g')"
    joined = rf"regexp_replace(regexp_replace({joined}, '([{VIRAMA}])\x{{200D}}', '\1{_KEPT}', 'g'), '([{SHAPED}])\x{{200D}}([^{SHAPED}]|$)', '\1{_KEPT}\2', 'g')"
    apart = t
    for _ in range(2):
        apart = rf"regexp_replace({apart}, '([{SHAPED}])\x{{200C}}([{SHAPED}])', '\1{_KEPT_NON}\2', 'g')"
    apart = rf"regexp_replace({apart}, '([{VIRAMA}])\x{{200C}}', '\1{_KEPT_NON}', 'g')"
    style = rf"regexp_replace({t}, '([{PICTOGRAM}])\x{{FE0E}}', '\1{_KEPT_STYLE}', 'g')"
    # a run of tags is seen only after a black flag and closed by the last tag
    tags = rf"regexp_replace(regexp_replace({t}, '\x{{1F3F4}}[\x{{E0020}}-\x{{E007E}}]+([^{TAGS}]|$)', chr(127988) || '\1', 'g'), '(^|[^\x{{1F3F4}}{TAGS}])[{TAGS}]+', '\1', 'g')"
    # a lambda over a list of one binds the text so far to a name
    bind = lambda body, value: f"list_transform([{value}], lambda x: {body})[1]"
    if column != "x":
        joined, apart, style, tags = (s.replace(f"({column},", "(x,") for s in (joined, apart, style, tags))
    for seen, kept in (("contains(x, chr(8205))", joined), ("contains(x, chr(8204))", apart), ("contains(x, chr(65038))", style), (f"regexp_matches(x, '[{TAGS}]')", tags)):
        t = bind(f"CASE WHEN {seen} THEN {kept} ELSE x END", t)
    t = f"regexp_replace({t}, '[{INVISIBLE}]+', '', 'g')"
    several = "x"
    for a, b in expansions().items():
        several = f"replace({several}, {q(a)}, {q(b)})"
    t = bind(f"CASE WHEN regexp_matches(x, '[{_ranges(list(expansions()))}]') THEN {several} ELSE x END", t)
    t = bind(f"CASE WHEN regexp_matches(x, '[{_ranges(list(table))}]') THEN translate(x, {q(''.join(table))}, {q(''.join(table.values()))}) ELSE x END", t)
    t = f"nfc_normalize({t})"
    t = rf"regexp_replace(regexp_replace({t}, '{LINE}', chr(10), 'g'), '[{BLANK}]+', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({t}, ' ?\n ?', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


def _in_duckdb(sql: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        try:
            for batch in batches:
                con.register("lote", pa.Table.from_batches([batch]))
                yield from con.sql(sql).to_arrow_table().to_batches()
                con.unregister("lote")
        finally:
            con.close()

    return run


def canonical(df: DataFrame, key: str, *texts: str) -> DataFrame:
    """``key`` and, for each text column, its canonical form under the column's own name. One row per row of ``df``; null stays null.

    For comparison: joiners and selectors that are seen are noncharacters here; ``written`` gives the text itself.
    """
    s = df.select(key, *texts)
    sql = f"SELECT {key}, {', '.join(f'{canonical_sql(t)} AS {t}' for t in texts)} FROM lote"
    return s.mapInArrow(_in_duckdb(sql), s.schema)


def written(df: DataFrame, key: str, *texts: str) -> DataFrame:
    """Like ``canonical``, for texts to be stored or shown: the marks that are seen are themselves again."""
    s = df.select(key, *texts)
    sql = f"SELECT {key}, {', '.join(f"translate({canonical_sql(t)}, '{_KEPT}{_KEPT_NON}{_KEPT_STYLE}', chr(8205) || chr(8204) || chr(65038)) AS {t}" for t in texts)} FROM lote"
    return s.mapInArrow(_in_duckdb(sql), s.schema)


def readings(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, forma (hash of the text as stored) and leitura (hash of its canonical form); null texts are left out."""
    sql = f"SELECT {key}, unhex(md5(t)) AS forma, unhex(md5({canonical_sql('t')})) AS leitura FROM lote"
    s = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("t"))
    return s.mapInArrow(_in_duckdb(sql), f"{key} {dict(s.dtypes)[key]}, forma binary, leitura binary")


def members(df: DataFrame, key: str = "postagem_id", text: str = "texto") -> DataFrame:
    """The records whose reading is stored in more than one form, distinct and kept in the checkpoint folder: key, forma, leitura.

    Only readings in several forms are of interest, so exact copies of one text alone meet nobody. Null texts are no case, empty ones read as nothing.
    """
    r = checkpoint(readings(df, key, text).distinct())
    several = r.groupBy("leitura").agg(F.min("forma").alias("_lo"), F.max("forma").alias("_hi")).where("_lo <> _hi").select("leitura")
    return r.join(several, "leitura", "left_semi").select(key, "forma", "leitura")


def membership(df: DataFrame, key: str = "postagem_id", text: str = "texto") -> DataFrame:
    """One row per record that has a link: key, classe (least key of its reading), representante (least key of its stored form), formas
    (of the class) and ligacoes (records of the class in another form). Every link is between two representatives of one class, see
    :func:`representative_pairs`; a hot reading stays two numbers per form, and nothing is expanded."""
    m = members(df, key, text)
    f = m.groupBy("leitura", "forma").agg(F.min(key).alias("representante"), F.count(F.lit(1)).alias("_n"))
    c = f.groupBy("leitura").agg(F.min("representante").alias("classe"), F.count(F.lit(1)).alias("formas"), F.sum("_n").alias("_todos"))
    f = f.join(c, "leitura").select(F.xxhash64("leitura", "forma").alias("_h"), "leitura", "forma", "classe", "representante", "formas", (F.col("_todos") - F.col("_n")).alias("ligacoes"))
    j = salted_join(m.select(key, F.xxhash64("leitura", "forma").alias("_h"), F.col("leitura").alias("_l"), F.col("forma").alias("_f")), f, "_h", how="inner", spread=F.xxhash64(key))
    return j.where("_l = leitura AND _f = forma").select(key, "classe", "representante", "formas", "ligacoes")


def representative_pairs(df: DataFrame, key: str = "postagem_id", text: str = "texto") -> DataFrame:
    """Pairs a < b of the least keys of two stored forms of one reading: all links between different texts, copies not expanded."""
    f = members(df, key, text).groupBy("leitura", "forma").agg(F.min(key).alias("r"))
    a, b = f.select("leitura", F.col("r").alias(f"{key}_a")), f.select("leitura", F.col("r").alias(f"{key}_b"))
    return salted_join(a, b, "leitura", how="inner", spread=F.xxhash64(f"{key}_a")).where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")


def same_reading(df: DataFrame, key: str = "postagem_id", text: str = "texto") -> DataFrame:
    """All pairs a < b of records whose texts read the same but are stored with different characters: the members of a class, expanded.

    As many rows as there are links; where those of a class would be too many, :func:`membership` and :func:`representative_pairs` say the same.
    The join is by reading, with hot readings salted; repeated keys count once.
    """
    varied = members(df, key, text)
    a, b = varied.select(F.col(key).alias(f"{key}_a"), F.col("forma").alias("_fa"), "leitura"), varied.select(F.col(key).alias(f"{key}_b"), F.col("forma").alias("_fb"), "leitura")
    pairs = salted_join(a, b, "leitura", how="inner", spread=F.xxhash64(f"{key}_a"))
    return pairs.where((F.col(f"{key}_a") < F.col(f"{key}_b")) & (F.col("_fa") != F.col("_fb"))).select(f"{key}_a", f"{key}_b").distinct()


def classes(df: DataFrame, key: str = "postagem_id", text: str = "texto") -> DataFrame:
    """One row per reading in more than one form: leitura (hex), formas (distinct stored forms), registros, menor key."""
    r = readings(df, key, text)
    g = r.groupBy("leitura").agg(F.countDistinct("forma").alias("formas"), F.count(F.lit(1)).alias("registros"), F.min(key).alias(f"menor_{key}"))
    return g.where("formas > 1").withColumn("leitura", F.hex("leitura"))
