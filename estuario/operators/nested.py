"""Deeply nested records as flat tables: content-addressed objects, stored once, and bridge rows from parent to child."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .skew import salted_join

KINDS = ("postagem", "mencao", "hashtag")
_SCHEMA = "arquivo_id bigint, linha int, tipo string, profundidade int, posicao int, pai binary, objeto binary, conteudo string"
_ARROW = pa.schema([("arquivo_id", pa.int64()), ("linha", pa.int32()), ("tipo", pa.string()), ("profundidade", pa.int32()), ("posicao", pa.int32()), ("pai", pa.binary()), ("objeto", pa.binary()), ("conteudo", pa.string())])
#: Between hashtags that come as one string.
_SEPARATORS = re.compile(r"[\s,;]+")
_QUOTED = ("quoted_status_result", "quoted")
#: Keys around a quoted record: ``{result: record}`` and, for limited posts, ``{result: {limited, tweet: record}}``.
_WRAPPERS = ("result", "tweet")


def _canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _hash(kind: str, text: str) -> bytes:
    return hashlib.blake2b(f"{kind}:{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _unwrap(value: object) -> tuple[dict | None, object]:
    """The record of a quoted slot, bare or below wrappers, and what else the slot holds; None for either where there is none.

    A slot without a record (unavailable posts) is held whole; one that is null or empty at its end holds nothing.
    """
    at, above = value, []
    while isinstance(at, dict) and "legacy" not in at and "core" not in at and (k := next((k for k in _WRAPPERS if k in at), None)):
        above.append((at, k))
        at = at[k]
    rest: dict = {}
    for holder, k in reversed(above):
        rest = {x: y for x, y in holder.items() if x != k} | ({k: rest} if rest else {})
    if isinstance(at, dict) and any(k in at for k in ("legacy", "core", "id", "user", "text", "body", "author", "mentions", "hashtags")):
        return at, rest or None
    return None, value if at or rest else None


def _lists(post: dict) -> tuple[dict | None, str, str]:
    legacy = post.get("legacy")
    if isinstance(legacy, dict):
        e = legacy.get("entities")
        return (e if isinstance(e, dict) else None), "user_mentions", "hashtags"
    return post, "mentions", "hashtags"


def decompose(record: dict) -> list[tuple[str, int, int | None, bytes | None, bytes, str]]:
    """The objects of one record, bottom-up: (tipo, profundidade, posicao, pai, objeto, conteudo).

    ``objeto`` is the hash of the canonical form in which every child object is replaced by its own hash (a Merkle identity), so equal
    subtrees have equal hashes wherever they occur. A post's children are its mentions, its hashtags and the post it quotes; what the
    quoted slot holds around that post, or in place of it, stays in the content.
    Places in a list count every element, nulls too; a lone object in place of a list has place 0; hashtags in one string are taken
    apart at blanks and commas. ``record`` itself is taken apart too.
    """
    chain: list[dict] = []
    post: dict | None = record
    while post is not None:
        chain.append(post)
        holder, post = post, None
        for k in _QUOTED:
            if k in holder and post is None:
                post, rest = _unwrap(holder.pop(k))
                if rest is not None:
                    holder[k] = rest
    out = []
    below, last = None, 0
    for depth in range(len(chain) - 1, -1, -1):
        post, children = chain[depth], []
        holder, *keys = _lists(post)
        for kind, key in zip(("mencao", "hashtag"), keys):
            items = holder.pop(key, None) if holder is not None else None
            if kind == "hashtag" and isinstance(items, str):
                items = [t for t in _SEPARATORS.split(items) if t]
            items = items if isinstance(items, list) else [] if items is None else [items]
            for i, x in enumerate(items):
                if x is not None:
                    text = _canonical(x)
                    children.append((kind, i, _hash(kind, text), text))
        text = _canonical(post | {"@filhos": [h.hex() for _, _, h, _ in children], "@cita": below and below.hex()})
        own = _hash("postagem", text)
        if below is not None:
            out[last] = (*out[last][:3], own, *out[last][4:])
        out += [(kind, depth, i, own, h, t) for kind, i, h, t in children]
        last = len(out)
        out.append(("postagem", depth, 0, None, own, text))
        below = own
    return out


def _flatten(kinds: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: set[bytes] = set()  # content travels once per batch and object
            rows = []
            for a, line, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    value = json.loads(text) if text else None
                    parts = decompose(value) if isinstance(value, dict) else []
                except (ValueError, RecursionError):
                    continue  # named by unreadable
                for kind, depth, i, parent, h, content in parts:
                    if kind in kinds:
                        rows.append((a, line, kind, depth, i, parent, h, None if h in known else content))
                        known.add(h)
            cols = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)

    return run


def flatten(registro: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Occurrences and, on the first one of each object in a batch, its canonical content.

    Payloads that are null, no JSON object, or nested beyond the parser's depth (some thousand levels) give no rows; :func:`unreadable`
    names them. Repeated records give repeated rows.
    """
    return registro.select(F.col("arquivo_id").cast("bigint"), F.col("linha").cast("int"), "payload").mapInArrow(_flatten(frozenset(kinds)), _SCHEMA)


def _reasons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for a, line, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            try:
                reason = "vazio" if not text or text.isspace() else None if isinstance(value := json.loads(text), dict) else "nao_objeto"
                if reason is None:
                    decompose(value)
            except RecursionError:
                reason = "profundo"
            except ValueError:
                reason = "json"
            if reason:
                rows.append((a, line, reason))
        cols = list(zip(*rows)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string()))], names=["arquivo_id", "linha", "motivo"])


def unreadable(registro: DataFrame) -> DataFrame:
    """The records that the flat tables lack, with the reason: arquivo_id, linha, motivo (vazio, json, nao_objeto, profundo)."""
    return registro.select(F.col("arquivo_id").cast("bigint"), F.col("linha").cast("int"), "payload").mapInArrow(_reasons, "arquivo_id bigint, linha int, motivo string")


def split(registro: DataFrame, kinds: tuple[str, ...] = KINDS) -> tuple[DataFrame, DataFrame]:
    """(pontes, objetos): one bridge row per occurrence, delivered twice or not, and each object once.

    pontes: arquivo_id, linha, tipo, profundidade, posicao, pai, objeto. objetos: objeto, tipo, conteudo. The payloads are parsed
    once; the flat rows are written once below the shared folder, compressed and by column, since both tables are read from them.
    """
    flat = keep(flatten(registro, kinds), "objetos")
    return flat.drop("conteudo").distinct(), _objects(flat)


def _objects(flat: DataFrame) -> DataFrame:
    return flat.where(F.col("conteudo").isNotNull()).groupBy("objeto").agg(F.min("tipo").alias("tipo"), F.min("conteudo").alias("conteudo"))


def _string(name: str) -> Column:
    """The string that ``conteudo`` is, or null."""
    return F.when(F.col("conteudo").startswith('"'), F.get_json_object(F.concat(F.lit('{"h":'), F.col("conteudo"), F.lit("}")), "$.h")).alias(name)


def _f(path: str) -> Column:
    return F.get_json_object("conteudo", f"$.{path}")


def _handle() -> Column:
    """The handle of a mention under each of its names; a bare string is a handle."""
    return F.lower(F.coalesce(_f("screen_name"), _f("username"), _f("handle"), _string("h"))).alias("handle")


def _tag() -> Column:
    return F.lower(F.coalesce(_f("text"), _string("h"))).alias("hashtag")


def _named(registro: DataFrame, kind: str, value: Column, name: str) -> DataFrame:
    """Distinct occurrences of one kind with a value of their object. One written table, one join with the objects, each stored once, and one
    distinct at the end, which also takes away the records delivered twice."""
    flat = keep(flatten(registro, (kind,)), kind)
    named = _objects(flat).select("objeto", value).where(F.col(name).isNotNull())
    b = flat.select("arquivo_id", "linha", "profundidade", "posicao", "objeto")
    return salted_join(b, named, "objeto", how="inner", spread=F.xxhash64("arquivo_id", "linha")).select("arquivo_id", "linha", "profundidade", "posicao", name).distinct()


def mentions(registro: DataFrame) -> DataFrame:
    """Every mention with a handle: arquivo_id, linha, profundidade, posicao, handle (lower case). Distinct rows."""
    return _named(registro, "mencao", _handle(), "handle")


def hashtags(registro: DataFrame) -> DataFrame:
    """Every hashtag: arquivo_id, linha, profundidade, posicao, hashtag (lower case). Distinct rows."""
    return _named(registro, "hashtag", _tag(), "hashtag")


def _with_content(registro: DataFrame, kind: str, *columns: Column) -> DataFrame:
    """Each occurrence of one kind with its parent and the given columns of its content, which are taken before anything is written."""
    flat = keep(flatten(registro, (kind,)).select("arquivo_id", "linha", "profundidade", "posicao", "pai", "objeto", F.when(F.col("conteudo").isNotNull(), F.struct(*columns)).alias("_c")), kind)
    objects = flat.where(F.col("_c").isNotNull()).groupBy("objeto").agg(F.min("_c").alias("_c"))
    out = salted_join(flat.drop("_c").distinct(), objects, "objeto", how="inner", spread=F.xxhash64("arquivo_id", "linha"), hot_from=flat.select("objeto"))
    return out.withColumns({"pai": F.hex("pai"), "objeto": F.hex("objeto")}).select("*", "_c.*").drop("_c")


def mention_table(registro: DataFrame) -> DataFrame:
    """Every mention, with a handle or not: arquivo_id, linha, profundidade, posicao, pai, objeto (hex), id_nativo, handle (lower case)."""
    return _with_content(registro, "mencao", _f("id_str").alias("id_nativo"), _handle()).select("arquivo_id", "linha", "profundidade", "posicao", "pai", "objeto", "id_nativo", "handle")


def hashtag_table(registro: DataFrame) -> DataFrame:
    """Every hashtag, with a text or not: arquivo_id, linha, profundidade, posicao, pai, objeto (hex), hashtag (lower case)."""
    return _with_content(registro, "hashtag", _tag()).select("arquivo_id", "linha", "profundidade", "posicao", "pai", "objeto", "hashtag")


# The keys of a post's own fields, base names first and then the later ones, below ``legacy`` or at the top.
_POST_FIELDS = {
    "id_nativo": ("legacy.id_str", "id"),
    "autor_handle": ("core.user_results.result.core.screen_name", "core.user_results.result.core.username", "user", "author"),
    "created_at": ("legacy.created_at", "created_at_iso", "createdAtIso"),
    "texto": ("legacy.full_text", "legacy.text", "text", "body"),
    "likes": ("legacy.favorite_count", "legacy.like_count", "like_count", "likes"),
}


def post_table(registro: DataFrame) -> DataFrame:
    """Every post, quoted ones too: arquivo_id, linha, profundidade, objeto, pai (hex), id_nativo, autor_handle, created_at, texto, likes as delivered (text).

    The author stays part of the post's content; a field that is in the record under no known name is null.
    """
    fields = [F.coalesce(*[_f(k) for k in keys]).alias(name) for name, keys in _POST_FIELDS.items()]
    return _with_content(registro, "postagem", *fields).select("arquivo_id", "linha", "profundidade", "objeto", "pai", *_POST_FIELDS)


def posts(registro: DataFrame) -> DataFrame:
    """Every post with its parent: arquivo_id, linha, profundidade, objeto, pai (hex, null for the record's own post), repeticoes.

    ``repeticoes`` is the number of occurrences of the same subtree in all records.
    """
    flat = keep(flatten(registro, ("postagem",)).select("arquivo_id", "linha", "profundidade", "objeto", "pai").distinct(), "postagens")
    n = flat.groupBy("objeto").agg(F.count(F.lit(1)).alias("repeticoes"))
    return salted_join(flat, n, "objeto", spread=F.xxhash64("arquivo_id", "linha"), hot_from=flat.select("objeto")).select("arquivo_id", "linha", "profundidade", F.hex("objeto").alias("objeto"), F.hex("pai").alias("pai"), "repeticoes")
