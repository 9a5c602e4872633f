"""Records whose schema drifts between files: versioned fingerprints, explicit migrations, one table and a report of every change."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base shape of each dialect. s string, i integer, n number with fraction, b boolean; a dict is an object, a list an array.
BASE = {
    "graphql": {
        "core": {"user_results": {"result": {"rest_id": "s", "core": {"screen_name": "s"}}}},
        "legacy": {
            "id_str": "s", "created_at": "s", "full_text": "s", "lang": "s", "in_reply_to_status_id_str": "s", "in_reply_to_screen_name": "s",
            "is_quote_status": "b", "favorite_count": "i", "retweet_count": "i", "quote_count": "i", "reply_count": "i",
            "entities": {"user_mentions": [{"id_str": "s", "screen_name": "s"}], "hashtags": [{"text": "s"}]},
        },
    },
    "consolidado": {
        "id": "s", "user": "s", "text": "s", "created_at_iso": "s", "in_reply_to_status_id": "s", "in_reply_to_user": "s", "stance": "s", "is_quote": "b",
        "like_count": "i", "retweet_count": "i", "quote_count": "i", "reply_count": "i", "mentions": [{"id_str": "s", "username": "s"}], "hashtags": ["s"],
    },
}
# Keys that may be absent anywhere and whose inside is never compared.
OPTIONAL = {"graphql": {"quoted_status_result", "legacy.entities.urls", "legacy.place"}, "consolidado": {"quoted", "media"}}
# The rename migrations known so far, base path to the later names of its last key. Spelling variants of the
# same words (snake or camel case) need no entry.
RENAMES = {
    "graphql": {
        "core.user_results.result.rest_id": ("user_id",),
        "core.user_results.result.core.screen_name": ("username", "handle"),
        "legacy.full_text": ("text", "body"),
        "legacy.favorite_count": ("like_count", "likes"),
        "legacy.in_reply_to_screen_name": ("reply_to_handle", "in_reply_to_user"),
        "legacy.lang": ("language",),
        "legacy.entities.user_mentions[].screen_name": ("username", "handle"),
    },
    "consolidado": {
        "user": ("author", "username", "screen_name"),
        "text": ("body", "full_text"),
        "stance": ("posicao",),
        "like_count": ("likes", "favorite_count"),
        "retweet_count": ("retweets",),
        "mentions[].username": ("handle", "screen_name"),
    },
}
_PRUNED = frozenset().union(*OPTIONAL.values())
_KIND = {"{": "objeto", "[": "lista", "s": "s", "i": "i", "n": "n", "b": "b"}
# What strings are like at the base paths where that tells them from all others.
CONTENT = {
    "graphql": {"core.user_results.result.rest_id": "numero", "legacy.id_str": "numero", "legacy.in_reply_to_status_id_str": "numero", "legacy.created_at": "data", "legacy.full_text": "texto", "legacy.entities.user_mentions[].id_str": "numero"},
    "consolidado": {"id": "numero", "in_reply_to_status_id": "numero", "created_at_iso": "data", "text": "texto", "stance": "rotulo", "mentions[].id_str": "numero"},
}
_CONTENTS = [
    ("numero", re.compile(r"\d{6,}")),
    ("data", re.compile(r"\d{4}-\d\d-\d\d[T ].*|\w{3} \w{3} \d\d? \d\d:\d\d:\d\d .*")),
    ("rotulo", re.compile(r"acusador|defensor|neutro")),
    ("texto", re.compile(r"\S+(\s+\S+){2,}", re.S)),
]
#: Words of keys that say nothing about their content.
_COMMON = {"count", "id", "str", "in", "is", "to", "at", "name"}


def dialect(fonte: Column) -> Column:
    """The dialect named by a loosely spelled fonte."""
    return F.lower(F.regexp_replace(fonte, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def shape(value: object, path: str = "") -> object:
    """The shape of a JSON value: objects as dicts by key, arrays as the list of their distinct element shapes, scalars as letters, null as z.

    What lies under an optional key is written as ``*``.
    """
    if isinstance(value, dict):
        out = {}
        for k in sorted(value):
            p = f"{path}.{k}" if path else k
            out[k] = "*" if p in _PRUNED else shape(value[k], p)
        return out
    if isinstance(value, list):
        seen = {}
        for v in value:
            s = shape(v, path + "[]")
            seen.setdefault(s if isinstance(s, str) else json.dumps(s), s)
        return [seen[k] for k in sorted(seen)]
    if value is None:
        return "z"
    if isinstance(value, str) and path and path.rpartition(".")[2].rstrip("[]") not in _KNOWN:
        return "s" + next((":" + name for name, form in _CONTENTS if form.fullmatch(value)), "")
    return "b" if isinstance(value, bool) else "s" if isinstance(value, str) else "i" if isinstance(value, int) else "n"


def fingerprint(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=12).hexdigest()


def _squash(key: str) -> str:
    return re.sub(r"[\W_]", "", key).lower()


def _keys(base: object) -> Iterator[str]:
    if isinstance(base, dict):
        for k, v in base.items():
            yield k
            yield from _keys(v)
    elif isinstance(base, list):
        yield from _keys(base[0])


#: Keys whose content needs no evidence: those of the base shapes and their known later names.
_KNOWN = frozenset(_keys(list(BASE.values())[0])) | frozenset(_keys(BASE["consolidado"])) | {n for r in RENAMES.values() for ns in r.values() for n in ns}


def _words(key: str) -> set[str]:
    """The telling words of a key, without a plural s."""
    return {w.lower().removesuffix("s") for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", key)} - _COMMON


def _evidence(fonte: str, path: str, base: object, got: object, key: str) -> bool:
    """Whether the new key of shape ``got`` holds the content of the absent base path: an object with at least half of its keys, a string of its
    telling kind, or a value of its JSON type under a key that shares a telling word with it."""
    if isinstance(base, dict) or isinstance(got, dict):
        return isinstance(base, dict) and isinstance(got, dict) and 2 * len(base.keys() & got.keys()) >= len(base)
    if isinstance(base, list) or isinstance(got, list):
        same = isinstance(base, list) and isinstance(got, list)
    else:
        kind = got.partition(":")[2]
        if base == "s" and kind and CONTENT[fonte].get(path) == kind:
            return True
        same = got[0] == base
    return same and bool(_words(path.rpartition(".")[2]) & _words(key))


def migration(fonte: str, form: object) -> list[tuple[str, str, str]]:
    """The steps that bring a record of shape ``form`` to the base shape of ``fonte``, in order: (passo, caminho, detalhe).

    renomear: detalhe is the key that holds the content of caminho. padrao: caminho is absent and becomes null. converter: caminho
    has another JSON type, given in detalhe. extra: caminho is new and kept aside. interno: a rename inside a lone object that stands
    in place of a list, which is carried out but not reported. Other containers of another type, and new ones, are not entered.

    A rename is recognised by the list of known names, by the same words in another spelling, or else by evidence in the record, which must
    fit one absent base key and one new key beside it alone.
    """
    steps: dict[tuple[str, str, str], None] = {}

    def visit(base: object, got: object, path: str) -> None:
        if got == "z":
            return
        want = "{" if isinstance(base, dict) else "[" if isinstance(base, list) else base
        have = "{" if isinstance(got, dict) else "[" if isinstance(got, list) else got[0]
        if want != have:
            steps[("converter", path, _KIND[have])] = None
            if want == "[" and have == "{" and isinstance(base[0], dict):
                for k, name in pairs(base[0], got, path + "[]").items():
                    steps[("interno", f"{path}[].{k}", name)] = None
        elif isinstance(base, list):
            for g in got:
                visit(base[0], g, path + "[]")
        elif isinstance(base, dict):
            at = lambda k: f"{path}.{k}" if path else k
            renamed = pairs(base, got, path)
            for k in base:
                if k in got:
                    visit(base[k], got[k], at(k))
                elif k in renamed:
                    steps[("renomear", at(k), renamed[k])] = None
                    visit(base[k], got[renamed[k]], at(k))
                else:
                    steps[("padrao", at(k), "")] = None
            for k in got:
                if k not in base and at(k) not in OPTIONAL[fonte] and k not in renamed.values():
                    steps[("extra", at(k), "")] = None

    def pairs(base: dict, got: dict, path: str) -> dict[str, str]:
        """The absent base keys whose content stands under a new key, with that key."""
        at = lambda k: f"{path}.{k}" if path else k
        new = [k for k in got if k not in base and at(k) not in OPTIONAL[fonte]]
        out: dict[str, str] = {}
        absent = [k for k in base if k not in got]
        for k in absent:
            names = RENAMES[fonte].get(at(k), ())
            found = next((n for n in names if n in new), None) or next((n for n in new if _squash(n) == _squash(k)), None)
            if found is not None:
                new.remove(found)
                out[k] = found
        fits = [(k, n) for k in absent if k not in out for n in new if n not in _KNOWN and _evidence(fonte, at(k), base[k], got[n], n)]
        for k, n in fits:
            if sum(x == k for x, _ in fits) == 1 == sum(y == n for _, y in fits):
                out[k] = n
        return out

    visit(BASE[fonte], form, "")
    return list(steps)


_SHAPES = pa.schema([("arquivo_id", pa.int64()), ("impressao", pa.string()), ("forma", pa.string()), ("registros", pa.int64())])


def _loads(text: str | None) -> object:
    """The JSON value, or None for null, unreadable or bottomless text."""
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count: dict[tuple[int, str], int] = {}
        for a, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            value = _loads(text)
            form = json.dumps(shape(value), separators=(",", ":")) if isinstance(value, dict) else None
            count[(a, form)] = count.get((a, form), 0) + 1
        keys = list(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in keys], pa.int64()), pa.array([f and fingerprint(f) for _, f in keys], pa.string()), pa.array([f for _, f in keys], pa.string()), pa.array(count.values(), pa.int64())], schema=_SHAPES
        )


def file_shapes(registro: DataFrame) -> DataFrame:
    """The distinct shapes of each file: arquivo_id, impressao, forma, registros. Counted per Arrow batch before the exchange.

    Repeated records count as they stand; a payload that is null or no JSON object has a null fingerprint.
    """
    raw = registro.select(F.col("arquivo_id").cast("bigint"), "payload").mapInArrow(_shapes, "arquivo_id bigint, impressao string, forma string, registros bigint")
    # one shape has one fingerprint, so any of them will do
    return raw.groupBy("arquivo_id", "impressao").agg(F.first("forma").alias("forma"), F.sum("registros").alias("registros"))


_STEPS = "arquivo_id bigint, fonte string, impressao string, registros bigint, ordem int, passo string, caminho string, detalhe string"


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plan = lru_cache(20_000)(lambda fonte, form: migration(fonte, json.loads(form)))
    for batch in batches:
        rows = [
            (a, fonte, fp, n, i, *step)
            for a, fonte, fp, form, n in zip(*(batch.column(i).to_pylist() for i in range(5)))
            for i, step in enumerate(plan(fonte, form), 1)
        ]
        cols = list(zip(*rows)) or [[]] * 8
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["arquivo_id", "fonte", "impressao", "registros", "ordem", "passo", "caminho", "detalhe"])


def _dialects(arquivo: DataFrame) -> DataFrame:
    """arquivo_id, fonte: the known dialect of each file, one row per file."""
    return arquivo.select(F.col("arquivo_id").cast("bigint").alias("arquivo_id"), dialect(F.col("fonte")).alias("fonte")).where(F.col("fonte").isin(list(BASE))).groupBy("arquivo_id").agg(F.min("fonte").alias("fonte"))


def file_migrations(registro: DataFrame, arquivo: DataFrame) -> DataFrame:
    """The migration steps of each shape of each file: arquivo_id, fonte, impressao, registros, ordem, passo, caminho, detalhe.

    Files of an unknown fonte or without a row in ``arquivo`` have no base shape and give no steps.
    """
    kinds = _dialects(arquivo)
    forms = file_shapes(registro).where(F.col("forma").isNotNull()).join(kinds, "arquivo_id").select("arquivo_id", "fonte", "impressao", "forma", "registros")
    return forms.mapInArrow(_plan, _STEPS)


def changes(steps: DataFrame) -> DataFrame:
    """The report of every change per file: arquivo_id, caminho, mudanca, registros (of the file that show it)."""
    name = F.create_map(*[F.lit(x) for x in ("renomear", "renomeado", "padrao", "removido", "converter", "tipo", "extra", "adicionado")])
    return steps.where("passo <> 'interno'").groupBy("arquivo_id", "caminho", name[F.col("passo")].alias("mudanca")).agg(F.sum("registros").alias("registros"))


def print_of(fonte: str, steps: list[tuple[str, str, str]]) -> str:
    """The fingerprint of a schema version: of the dialect and its migration steps."""
    return hashlib.sha256(f"{fonte}:{'; '.join(' '.join(x).rstrip() for x in steps)}".encode()).hexdigest()[:16]


def versions(registro: DataFrame, arquivo: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The registry of schema versions: fonte, versao, impressao, passos, arquivos, registros.

    A version is a set of migration steps other than none; ``impressao`` is its fingerprint, which every record of :func:`one_table` names.
    ``versao`` starts at 1 per fonte, in order of first appearance. ``known`` is the registry of earlier runs: its versions keep their
    numbers and steps, and new ones are numbered after them; arquivos and registros count this run's files alone.
    """
    from pyspark.sql import Window as W

    seen = arquivo.groupBy(F.col("arquivo_id").cast("bigint").alias("arquivo_id")).agg(F.min("ingerido_em").alias("visto_em"))
    step = F.rtrim(F.concat_ws(" ", "passo", "caminho", "detalhe"))
    per = file_migrations(registro, arquivo).groupBy("arquivo_id", "fonte", "impressao").agg(F.max("registros").alias("registros"), F.sort_array(F.collect_list(F.struct("ordem", step.alias("p")))).alias("l"))
    per = per.select("arquivo_id", "fonte", "registros", F.array_join(F.transform("l", lambda x: x["p"]), "; ").alias("passos")).join(seen, "arquivo_id")
    v = per.groupBy("fonte", "passos").agg(F.min("visto_em").alias("visto_em"), F.countDistinct("arquivo_id").alias("arquivos"), F.sum("registros").alias("registros"))
    v = v.withColumn("impressao", F.substring(F.sha2(F.concat("fonte", F.lit(":"), "passos"), 256), 1, 16))
    order = W.partitionBy("fonte").orderBy(F.col("visto_em").asc_nulls_last(), "passos")
    if known is None:
        return v.select("fonte", F.row_number().over(order).alias("versao"), "impressao", "passos", "arquivos", "registros")
    old = known.select("fonte", "versao", "impressao", "passos").join(v.select("fonte", "impressao", "arquivos", "registros"), ["fonte", "impressao"], "left").fillna({"arquivos": 0, "registros": 0})
    last = known.groupBy("fonte").agg(F.max("versao").alias("_max"))
    new = v.join(known.select("fonte", "impressao"), ["fonte", "impressao"], "left_anti").join(last, "fonte", "left")
    new = new.select("fonte", (F.row_number().over(order) + F.coalesce("_max", F.lit(0))).alias("versao"), "impressao", "passos", "arquivos", "registros")
    return old.select(*new.columns).unionByName(new)


# Where each column of the one table lies in each dialect.
COLUMNS = {
    "graphql": {
        "id_nativo": "legacy.id_str", "autor_handle": "core.user_results.result.core.screen_name", "autor_id_nativo": "core.user_results.result.rest_id", "created_at": "legacy.created_at",
        "texto": "legacy.full_text", "idioma": "legacy.lang", "ref_status_id": "legacy.in_reply_to_status_id_str", "ref_handle": "legacy.in_reply_to_screen_name", "eh_quote": "legacy.is_quote_status",
        "likes": "legacy.favorite_count", "retweets": "legacy.retweet_count", "quotes": "legacy.quote_count", "respostas": "legacy.reply_count",
        "mencoes": "legacy.entities.user_mentions", "hashtags": "legacy.entities.hashtags",
    },
    "consolidado": {
        "id_nativo": "id", "autor_handle": "user", "created_at": "created_at_iso", "texto": "text", "ref_status_id": "in_reply_to_status_id", "ref_handle": "in_reply_to_user", "eh_quote": "is_quote",
        "likes": "like_count", "retweets": "retweet_count", "quotes": "quote_count", "respostas": "reply_count", "mencoes": "mentions", "hashtags": "hashtags", "stance_previa": "stance",
    },
}
_TABLE = (
    "arquivo_id bigint, linha int, fonte string, impressao string, id_nativo string, autor_handle string, autor_id_nativo string, created_at string, texto string, idioma string, ref_status_id string, ref_handle string, "
    "eh_quote boolean, likes bigint, retweets bigint, quotes bigint, respostas bigint, mencoes array<struct<id_nativo:string,handle:string>>, hashtags array<string>, stance_previa string, extras string, opcionais string"
)
_ITEM = pa.struct([("id_nativo", pa.string()), ("handle", pa.string())])
_KINDS = {"eh_quote": pa.bool_(), "likes": pa.int64(), "retweets": pa.int64(), "quotes": pa.int64(), "respostas": pa.int64(), "mencoes": pa.list_(_ITEM), "hashtags": pa.list_(pa.string()), "arquivo_id": pa.int64(), "linha": pa.int32()}
_NAMES = [c.split()[0] for c in re.sub(r"<[^ ]*>", "", _TABLE).split(", ")]


def _base(fonte: str, path: str) -> object:
    at: object = BASE[fonte]
    for k in path.split("."):
        name = k.rstrip("[]")
        at = at[name]
        for _ in range(k.count("[]")):
            at = at[0]
    return at


def apply_steps(fonte: str, value: dict, steps: list[tuple[str, str, str]]) -> tuple[dict, dict]:
    """The record in the base shape and, apart, its new fields by path. ``steps`` are those of its shape and run in their order.

    A new field of list elements is kept for every element: ``{place: value}`` with the place in the list (places of nested lists are joined by a point).
    """
    extras: dict[str, object] = {}

    def holders(keys: list[str]) -> list[tuple[str, dict]]:
        """The objects at a path, each with its places in the lists on the way."""
        at: list[tuple[str, object]] = [("", value)]
        for k in keys:
            name = k.removesuffix("[]")
            at = [(p, x[name]) for p, x in at if isinstance(x, dict) and name in x]
            if name != k:
                at = [(f"{p}.{i}" if p else str(i), y) for p, x in at for i, y in enumerate(x if isinstance(x, list) else [x])]
        return [(p, x) for p, x in at if isinstance(x, dict)]

    for step, path, detail in steps:
        *parents, last = path.split(".")
        name = last.removesuffix("[]")
        for place, h in holders(parents):
            if step in ("renomear", "interno"):
                if detail in h and name not in h:
                    h[name] = h.pop(detail)
            elif step == "padrao":
                h.setdefault(name, None)
            elif step == "converter" and name in h:
                base = _base(fonte, path)
                h[name] = [convert(base, x) for x in h[name]] if name != last and isinstance(h[name], list) else convert(base, h[name])
            elif step == "extra" and name in h:
                if place:
                    extras.setdefault(path, {})[place] = h.pop(name)
                else:
                    extras[path] = h.pop(name)
    return value, extras


#: Under which key an object that stands in place of a string holds it, first found first.
_INNER = ("label", "text", "name", "value", "id_str")
_SEPARATED = re.compile(r"[\s,;]+")


def convert(base: object, v: object) -> object:
    """The cast rules: ``v`` as the base shape has it, null where that can't be.

    A lone element is a list of one, but a string in place of a list of strings is taken apart at blanks and commas; a bare value in place of an
    object is its last key's (the handle of a mention, the text of a hashtag); an object in place of a string is its label; counts
    and flags are read from text.
    """
    if v is None:
        return None
    if isinstance(base, list):
        words = isinstance(v, str) and (base[0] == "s" or len(base[0]) == 1)
        items = v if isinstance(v, list) else [x for x in _SEPARATED.split(v) if x] if words else [v]
        return [convert(base[0], x) for x in items]
    if isinstance(base, dict):
        return v if isinstance(v, dict) else {list(base)[-1]: _text(v)}
    if base == "s":
        return _text(next((v[k] for k in _INNER if k in v), v) if isinstance(v, dict) else v)
    return _flag(v) if base == "b" else _whole(v)


def _text(v: object) -> str | None:
    return None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _whole(v: object) -> int | None:
    try:
        n = int(float(v)) if isinstance(v, (int, float, str)) and not isinstance(v, int) else v if isinstance(v, int) else None
        return n if n is None or -(2**63) <= n < 2**63 else None
    except (ValueError, OverflowError):
        return None


def _flag(v: object) -> bool | None:
    return v if isinstance(v, bool) else bool(v) if isinstance(v, (int, float)) else {"true": True, "1": True, "false": False, "0": False}.get(v.strip().lower()) if isinstance(v, str) else None


def _column(name: str, v: object, fonte: str) -> object:
    """A value in the base shape as the table has it: handles and hashtags in lower case, empty references and labels null, null elements left out."""
    if name in ("likes", "retweets", "quotes", "respostas"):
        return v if isinstance(v, int) and -(2**63) <= v < 2**63 else None
    if name == "eh_quote":
        return v if isinstance(v, bool) else None
    if name == "mencoes":
        handle = "screen_name" if fonte == "graphql" else "username"
        out = [(_text(x.get("id_str")), _text(x.get(handle))) for x in v or [] if isinstance(x, dict)]
        return [{"id_nativo": i, "handle": h and h.lower()} for i, h in out]
    if name == "hashtags":
        tags = [_text(x.get("text")) if isinstance(x, dict) else _text(x) for x in v or []]
        return [t.lstrip("#").lower() for t in tags if t and t.strip()]
    v = _text(v)
    if name in ("ref_status_id", "ref_handle", "stance_previa"):
        v = v or None
    return v.lower() if v and name == "ref_handle" else v


def _optional(fonte: str, value: dict) -> dict:
    out = {}
    for path in sorted(OPTIONAL[fonte]):
        at: object = value
        for k in path.split("."):
            at = at.get(k) if isinstance(at, dict) else None
        if at is not None:
            out[path] = at
    return out


def _route(optional: bool):
    names = _NAMES if optional else [n for n in _NAMES if n != "opcionais"]
    paths = {f: {n: p.split(".") for n, p in cols.items()} for f, cols in COLUMNS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(20_000)
        def plan(fonte: str, form: str) -> tuple[str, list]:
            steps = migration(fonte, json.loads(form))
            return print_of(fonte, steps), steps

        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for a, line, text, named in zip(*(batch.column(i).to_pylist() for i in range(4))):
                value = _loads(text)
                row: dict[str, object] = {"arquivo_id": a, "linha": line}
                if isinstance(value, dict):
                    fonte = named if named in BASE else "graphql" if "legacy" in value or "core" in value else "consolidado"
                    fp, steps = plan(fonte, json.dumps(shape(value), separators=(",", ":")))
                    rest = _optional(fonte, value) if optional else {}
                    value, extras = apply_steps(fonte, value, steps)
                    js = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True) if x else None
                    row |= {"fonte": fonte, "impressao": fp, "extras": js(extras), "opcionais": js(rest)}
                    for name, path in paths[fonte].items():
                        v: object = value
                        for k in path:
                            v = v.get(k) if isinstance(v, dict) else None
                        row[name] = _column(name, v, fonte)
                for n in names:
                    out[n].append(row.get(n))
            yield pa.RecordBatch.from_arrays([pa.array(out[n], _KINDS.get(n, pa.string())) for n in names], names=names)

    return run


def one_table(registro: DataFrame, arquivo: DataFrame | None = None, *, optional: bool = True) -> DataFrame:
    """All records in one schema, each routed through the rename, default and cast steps of its shape.

    ``impressao`` names the schema version (see :func:`versions`), new fields are kept in ``extras`` and the optional ones (quoted posts, media,
    places, links) in ``opcionais``, both as JSON by path; without ``optional`` that column is left out. The dialect is the file's fonte in
    ``arquivo``; where that is unknown, or no ``arquivo`` is given, the record's own keys decide.
    One row per record of ``registro``, repeated ones too; a payload that is null or no JSON object gives a row of nulls.
    The fonte is joined by Spark's own choice (broadcast below its size threshold); all else happens within the scan.
    """
    r = registro.select(F.col("arquivo_id").cast("bigint").alias("arquivo_id"), F.col("linha").cast("int").alias("linha"), "payload")
    if arquivo is None:
        r = r.withColumn("_fonte", F.lit(None).cast("string"))
    else:
        r = r.join(_dialects(arquivo).withColumnRenamed("fonte", "_fonte"), "arquivo_id", "left")
    return r.mapInArrow(_route(optional), _TABLE if optional else _TABLE.removesuffix(", opcionais string"))
