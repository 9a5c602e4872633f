"""Drift, instants, skew, nesting and references against brute force on small fixtures."""

import datetime as dt
import json
import random
import zoneinfo

import duckdb
import pytest
from pyspark.sql import functions as F

from estuario.operators import drift, instants, nested, references, skew
from estuario.queries import data_problems

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"

# -- drift


def gql(**legacy):
    base = {"id_str": "1", "created_at": "x", "full_text": "t", "lang": "pt", "in_reply_to_status_id_str": None, "in_reply_to_screen_name": None, "is_quote_status": False, "favorite_count": 1, "retweet_count": 1, "quote_count": 1, "reply_count": 1, "entities": {"user_mentions": [], "hashtags": []}}
    return {"core": {"user_results": {"result": {"rest_id": "9", "core": {"screen_name": "Ana"}}}}, "legacy": base | legacy}


def cons(drop=(), **k):
    base = {"id": "1", "user": "a", "text": "t", "created_at_iso": "x", "in_reply_to_status_id": "", "in_reply_to_user": "", "stance": "", "is_quote": False, "like_count": 1, "retweet_count": 1, "quote_count": 1, "reply_count": 1, "mentions": [], "hashtags": []}
    return {x: v for x, v in (base | k).items() if x not in drop}


def found(spark, fonte, *records):
    reg = spark.createDataFrame([(1, i, r if isinstance(r, str) or r is None else json.dumps(r), "x") for i, r in enumerate(records, 1)], "arquivo_id bigint, linha int, payload string, fonte string")
    arq = spark.createDataFrame([(1, fonte, dt.datetime(2024, 1, 1)), (2, "outra", None), (None, "graphql", None)], "arquivo_id bigint, fonte string, ingerido_em timestamp_ntz")
    return {(r.caminho, r.mudanca): r.registros for r in drift.changes(drift.file_migrations(reg, arq)).collect()}, drift.one_table(reg).collect()


def test_drift_none(spark):
    optional = gql(place={"bbox": [[1.5]]}) | {"quoted_status_result": {"result": {"legacy": {"novo": 1}}}}
    assert found(spark, " GraphQL ", gql(), gql(lang=None), optional, None, "no json", "[1]")[0] == {}


@pytest.mark.parametrize(
    ("record", "want"),
    [
        (cons(drop=["text"], body="x"), {("text", "renomeado")}),
        (cons(drop=["created_at_iso"], createdAtIso="x"), {("created_at_iso", "renomeado")}),
        (cons(drop=["created_at_iso"], views=3), {("created_at_iso", "removido"), ("views", "adicionado")}),
        (cons(likes=3), {("likes", "adicionado")}),
        (cons(drop=["like_count"], likes="3"), {("like_count", "renomeado"), ("like_count", "tipo")}),
        (cons(id=1), {("id", "tipo")}),
        (cons(quote_count=1.0), {("quote_count", "tipo")}),
        (cons(is_quote=1), {("is_quote", "tipo")}),
        (cons(hashtags="a b"), {("hashtags", "tipo")}),
        (cons(hashtags=["a", {"text": "b"}]), {("hashtags[]", "tipo")}),
        (cons(stance={"label": "neutro", "score": 0.5}), {("stance", "tipo")}),
        (cons(mentions=[{"id_str": "1", "username": "a"}, None, {"id_str": None, "handle": "b"}]), {("mentions[].username", "renomeado")}),
        (cons(mentions=[{"username": "a", "verified": True}]), {("mentions[].verified", "adicionado"), ("mentions[].id_str", "removido")}),
        (cons(mentions={"username": "a", "novo": 1}), {("mentions", "tipo")}),
        (cons(geo={"lat": 1.5, "x": {"y": 1}}), {("geo", "adicionado")}),
        (cons(text=None), set()),
    ],
)
def test_drift_one_change(spark, record, want):
    assert set(found(spark, "consolidado", cons(), record)[0]) == want


def test_one_table_routes_every_record(spark):
    a = gql(favorite_count="7", is_quote_status="true", entities={"user_mentions": {"id_str": "5", "screen_name": "Bia"}, "hashtags": ["Um", {"text": "Dois"}]})
    del a["legacy"]["full_text"]
    a["legacy"]["text"], a["novo"] = "corpo", [1]
    rows = found(spark, "graphql", a, None, "x", json.dumps(cons(id=12, stance={"label": "neutro"}, hashtags="#a b")))[1]
    r = {x.linha: x for x in rows}
    assert len(rows) == 4 and r[1].texto == "corpo" and r[1].likes == 7 and r[1].eh_quote and r[1].hashtags == ["um", "dois"]
    assert [m.asDict() for m in r[1].mencoes] == [{"id_nativo": "5", "handle": "bia"}] and json.loads(r[1].extras) == {"novo": [1]}
    assert r[2].id_nativo is None and r[3].fonte is None and r[4].id_nativo == "12" and r[4].stance_previa == "neutro" and r[4].hashtags == ["a", "b"]


def test_new_fields_of_list_elements_keep_all_values(spark):
    a = cons(mentions=[{"id_str": "1", "username": "A", "verified": True}, None, {"id_str": "2", "username": "b", "verified": False}, {"id_str": "3", "username": "c"}], media=[{"u": 1}], quoted=cons(id="7"))
    r = found(spark, "consolidado", a)[1][0]
    assert json.loads(r.extras) == {"mentions[].verified": {"0": True, "2": False}}
    assert json.loads(r.opcionais)["media"] == [{"u": 1}] and json.loads(r.opcionais)["quoted"]["id"] == "7" and [m.handle for m in r.mencoes] == ["a", "b", "c"]


def test_steps_run_in_order():
    value = {"user": "a", "likes": "7", "is_quote": 1, "quote_count": 2.0, "mentions": {"id_str": 5, "handle": "Z"}, "hashtags": "x, y", "stance": {"label": "neutro"}, "novo": [1]}
    steps = drift.migration("consolidado", drift.shape(value))
    assert ("interno", "mentions[].username", "handle") in steps and ("padrao", "id", "") in steps
    got, extras = drift.apply_steps("consolidado", value, steps)
    assert extras == {"novo": [1]} and got["id"] is None and got["text"] is None and set(got) == set(drift.BASE["consolidado"])
    assert (got["like_count"], got["is_quote"], got["quote_count"], got["hashtags"], got["stance"]) == (7, True, 2, ["x", "y"], "neutro")
    assert got["mentions"] == [{"id_str": 5, "username": "Z"}]
    assert drift.convert([{"text": "s"}], "#a b") == [{"text": "#a"}, {"text": "b"}] and drift.convert("i", "x") is None and drift.convert("i", 10**30) is None and drift.convert("b", "TRUE") is True and drift.convert("s", 1.5) == "1.5"


@pytest.mark.parametrize(
    ("fonte", "record", "want"),
    [
        ("consolidado", cons(drop=["text"], conteudo="um texto de quatro palavras"), {("text", "renomeado")}),
        ("consolidado", cons(drop=["created_at_iso"], quando="2024-01-01T10:00:00Z"), {("created_at_iso", "renomeado")}),
        ("consolidado", cons(drop=["retweet_count"], total_retweets=4), {("retweet_count", "renomeado")}),
        ("consolidado", cons(drop=["reply_count"], views=4), {("reply_count", "removido"), ("views", "adicionado")}),
        ("consolidado", cons(drop=["stance"], idioma="pt"), {("stance", "removido"), ("idioma", "adicionado")}),
        ("consolidado", cons(drop=["stance"], opiniao="neutro"), {("stance", "renomeado")}),
        ("consolidado", cons(drop=["text"], a="um texto de quatro", b="outro texto de cinco"), {("text", "removido"), ("a", "adicionado"), ("b", "adicionado")}),
        ("graphql", {"core": gql()["core"], "legado": gql()["legacy"]}, {("legacy", "renomeado")}),
    ],
)
def test_renames_by_evidence(spark, fonte, record, want):
    steps, rows = found(spark, fonte, record)
    assert set(steps) == want
    if fonte == "graphql":
        # without its file the record would pass for the other dialect
        reg = spark.createDataFrame([(1, 1, json.dumps(record))], "arquivo_id bigint, linha int, payload string")
        r = drift.one_table(reg, spark.createDataFrame([(1, " GraphQL")], "arquivo_id bigint, fonte string")).first()
        assert (r.fonte, r.id_nativo, r.texto) == ("graphql", "1", "t")


def test_registry_is_extended(spark):
    reg = lambda *rs: spark.createDataFrame([(i, 1, json.dumps(r)) for i, r in enumerate(rs)], "arquivo_id bigint, linha int, payload string")
    arq = spark.createDataFrame([(i, "consolidado", dt.datetime(2024, 1, 1 + i)) for i in range(4)], "arquivo_id bigint, fonte string, ingerido_em timestamp_ntz")
    one, two = cons(drop=["text"], body="x"), cons(views=1)
    first = drift.versions(reg(cons(), one), arq)
    assert [(r.versao, r.passos, r.arquivos) for r in first.collect()] == [(1, "renomear text body", 1)]
    again = {r.passos: r for r in drift.versions(reg(two, one, one), arq, first).collect()}
    assert {k: (r.versao, r.arquivos) for k, r in again.items()} == {"renomear text body": (1, 2), "extra views": (2, 1)}
    later = {r.passos: (r.versao, r.arquivos) for r in drift.versions(reg(cons()), arq, drift.versions(reg(two, one), arq, first)).collect()}
    assert later == {"renomear text body": (1, 0), "extra views": (2, 0)}
    prints = {r.impressao for r in drift.one_table(reg(two, one), arq).collect()}
    assert prints == {r.impressao for r in again.values()}


OTHER_NAMES = {
    "graphql": {"lang": "idioma", "language": "idioma", "favorite_count": "likes", "like_count": "likes", "likes": "likes", "retweet_count": "retweets", "quote_count": "quotes", "reply_count": "respostas"},
    "consolidado": {"like_count": "likes", "likes": "likes", "favorite_count": "likes", "retweet_count": "retweets", "retweets": "retweets", "quote_count": "quotes", "reply_count": "respostas", "stance": "stance_previa", "posicao": "stance_previa"},
}
PLAIN = {
    "graphql": {"core", "legacy", "quoted_status_result"} | {"id_str", "created_at", "full_text", "text", "body", "in_reply_to_status_id_str", "in_reply_to_screen_name", "reply_to_handle", "in_reply_to_user", "is_quote_status", "entities", "place"},
    "consolidado": {"id", "user", "author", "username", "screen_name", "text", "body", "full_text", "created_at_iso", "in_reply_to_status_id", "in_reply_to_user", "is_quote", "mentions", "hashtags", "quoted", "media"},
}
squash = lambda k: k.replace("_", "").lower()


def by_hand_columns(v):
    """The columns that p3_tabela leaves out, from the payload itself; extras as the set of new keys outside core and entities."""
    fonte = "graphql" if "legacy" in v or "core" in v else "consolidado"
    known, plain = {squash(k): c for k, c in OTHER_NAMES[fonte].items()}, {squash(k) for k in PLAIN[fonte]}
    top = v.get("legacy") or {} if fonte == "graphql" else v
    row = {"fonte": fonte, "idioma": None, "retweets": None, "quotes": None, "respostas": None, "stance_previa": None}
    for k, x in top.items():
        c = known.get(squash(k))
        if c in ("retweets", "quotes", "respostas"):
            row[c] = None if x is None or x == "" else int(float(x))
        elif c == "stance_previa":
            row[c] = (x.get("label") if isinstance(x, dict) else x) or None
        elif c == "idioma":
            row[c] = x
    items = (top.get("entities") or {}).get("user_mentions") if fonte == "graphql" else v.get("mentions")
    items = items if isinstance(items, list) else [] if items is None else [items]
    row["mencoes"] = [(m.get("id_str"), next((m[k].lower() for k in ("screen_name", "username", "handle") if m.get(k)), None)) if isinstance(m, dict) else (None, m.lower()) for m in items if m is not None]
    new = {("legacy." if fonte == "graphql" else "") + k for k in top if squash(k) not in known and squash(k) not in plain}
    return row, new | ({k for k in v if squash(k) not in plain} if fonte == "graphql" else set())


def test_whole_table_against_payloads(spark):
    rows = data_problems.QUERIES["p3_tabela_completa"](spark, SF).collect()
    source = duckdb.sql(f"SELECT arquivo_id, linha, payload FROM '{SF}/registro.parquet'").fetchall()
    assert len(rows) == len(source) and len(rows[0]) == 22
    payloads = {(a, n): p for a, n, p in source}
    filled, prints = set(), {}
    for r in rows:
        text = payloads[r.arquivo_id, r.linha]
        try:
            v = json.loads(text) if text else None
        except ValueError:
            v = None
        if not isinstance(v, dict):
            assert r.fonte is None and r.impressao is None and r.extras is None
            continue
        want, new = by_hand_columns(v)
        got = {k: r[k] for k in want} | {"mencoes": [tuple(m) for m in r.mencoes]}
        assert got == want, (got, want, text)
        extras = {k: x for k, x in json.loads(r.extras or "{}").items() if not k.startswith(("core.", "legacy.entities.", "mentions[]", "hashtags[]"))}
        holder = {k.removeprefix("legacy."): x for k, x in extras.items()}
        assert set(extras) == new and all((v.get("legacy", {}).get(k, v.get(k)) if want["fonte"] == "graphql" else v.get(k)) == x for k, x in holder.items()), (extras, new)
        assert prints.setdefault(r.impressao, r.fonte) == r.fonte
        top = v.get("legacy") or {}
        rest = {"quoted": v.get("quoted"), "media": v.get("media")} if want["fonte"] == "consolidado" else {"quoted_status_result": v.get("quoted_status_result"), "legacy.place": top.get("place"), "legacy.entities.urls": (top.get("entities") or {}).get("urls")}
        assert json.loads(r.opcionais or "{}") == {k: x for k, x in rest.items() if x is not None}
        filled |= {k for k in (*want, "extras", "impressao") if r[k]}
    assert filled == {"fonte", "impressao", "idioma", "retweets", "quotes", "respostas", "mencoes", "stance_previa", "extras"} and len(prints) > 10


# -- instants


CASES = [
    ("2024-03-10T10:42:36.429Z", "UTC", "2024-03-10 10:42:36.429"), ("  2024-03-10 10:42", "Asia/Tokyo", "2024-03-10 01:42"), ("11/03/23 04:59", "UTC", "2023-03-11 04:59"), ("1678521021", "Asia/Tokyo", "2023-03-11 07:50:21"),
    ("1698065494859", "UTC", "2023-10-23 12:51:34.859"), ("20241024T110615Z", "Asia/Tokyo", "2024-10-24 11:06:15"), ("2024-03-10T10:24:01.133408+00:00", "UTC", "2024-03-10 10:24:01.133408"), ("Thu, 16 Mar 2023 17:48:36 GMT", "Asia/Tokyo", "2023-03-16 17:48:36"),
    ("11/03/2023 às 19h28", "America/Sao_Paulo", "2023-03-11 22:28"), ("2024-03-10 11:34:15 CET", "UTC", "2024-03-10 10:34:15"), ("Sun Nov 05 02:53:38 -0500 2023", "UTC", "2023-11-05 07:53:38"), ("11 de março de 2023, 08:04:06", "UTC", "2023-03-11 08:04:06"),
    ("2024-10-24 14:03:47.163+0200", "UTC", "2024-10-24 12:03:47.163"), ("2023-10-23T09:11:02-04", "UTC", "2023-10-23 13:11:02"), ("2023-10-29T12:40:01-04:00[America/New_York]", "UTC", "2023-10-29 16:40:01"), ("Mar 11, 2023 5:06:14 PM", "UTC", "2023-03-11 17:06:14"),
    ("Mar 11, 2023 12:06:14 AM", "UTC", "2023-03-11 00:06:14"), ("Mar 11, 2023 12:06:14 PM", "UTC", "2023-03-11 12:06:14"), ("2023-10-29T07:17:38Z[UTC]", "Asia/Tokyo", "2023-10-29 07:17:38"),
    # twice: the first one; skipped: forward by the gap
    ("2023-10-29 01:44", "Europe/Lisbon", "2023-10-29 00:44"), ("2023-11-05T01:45:11", "America/New_York", "2023-11-05 05:45:11"), ("31/03/2024 01:30:35", "Europe/Lisbon", "2024-03-31 01:30:35"), ("2023-03-26T02:56:15", "Europe/Madrid", "2023-03-26 01:56:15"),
    ("2011-12-30T10:00:00", "Pacific/Apia", "2011-12-30 20:00:00"), ("2024-02-29 00:00", "UTC", "2024-02-29 00:00"),
]
NO = ["", " ", None, "há 3 horas", "sem data", "null", "2023-02-30T10:00:00Z", "2024-13-05 08:00:00", "0000-00-00 00:00:00", "31/04/2024 12:00:00", "2023-02-29 10:00", "2023-01-01 24:00", "2023-01-01 10:60", "2023-01-01 10:10:60", "2023-01-01T10:10:10 QQQ", "13:10", "2023-01-01", "x" * 100_000]


def test_instants_by_case(spark):
    zones = sorted({z for _, z, _ in CASES})
    rows = [(zones.index(z), i, t) for i, (t, z, _) in enumerate(CASES)] + [(0, 1000 + i, t) for i, t in enumerate(NO)] + [(99, 5000, "2024-01-01 10:00"), (None, 5001, "2024-01-01 10:00"), (99, 5002, "2024-01-01 10:00Z")]
    df = spark.createDataFrame(rows, "arquivo_id bigint, linha int, created_at string").withColumns({"fuso": F.lit("ruim"), "ano": F.lit(7), "intervalos": F.lit(8), "situacao": F.lit("x"), "de": F.lit(9)})
    z = spark.createDataFrame([(i, f" {n}") for i, n in enumerate(zones)] + [(98, "Marte/Olimpo")], "arquivo_id bigint, fuso string")
    got = {r.linha: (r.instante_us, r.situacao) for r in instants.to_instants(df, z).collect()}
    for i, (t, zone, want) in enumerate(CASES):
        at = dt.datetime.fromisoformat(want).replace(tzinfo=dt.UTC)
        assert got[i][0] == round(at.timestamp() * 1e6), (t, zone, got[i])
    assert all(got[1000 + i] == (None, "ilegivel") for i in range(len(NO))), [(NO[i], got[1000 + i]) for i in range(len(NO)) if got[1000 + i][0] is not None]
    assert got[5000] == (None, "sem_fuso") and got[5001] == (None, "sem_fuso") and got[5002][1] == "explicita"
    out = instants.to_instants(df, z)
    assert len(got) == len(rows) and {"ano", "intervalos", "de"} < set(out.columns) and out.agg(F.min("ano"), F.max("intervalos")).first()[:] == (7, 8)
    assert instants.to_instants(df.limit(0), z).count() == 0
    assert instants.to_instants(df, z.limit(0)).where("situacao = 'explicita'").count() > 10


def test_instants_against_zoneinfo(spark):
    """Wall clocks around every change of several zones, against the standard library's rules."""
    rng, rows = random.Random(1), []
    zones = ["America/Sao_Paulo", "America/New_York", "Europe/Lisbon", "Europe/Madrid", "Asia/Tokyo", "UTC", "Australia/Lord_Howe"]
    for i in range(4000):
        rows.append((rng.randrange(len(zones)), i, (dt.datetime(1990, 1, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 365 * 40))).strftime("%Y-%m-%d %H:%M")))
    for i in range(4000, 6000):  # near the usual days of change
        month, day = rng.choice([(3, 8), (3, 12), (3, 26), (3, 31), (4, 7), (10, 6), (10, 29), (10, 27), (11, 5), (11, 3)])
        rows.append((rng.randrange(len(zones)), i, f"{rng.randrange(2005, 2030)}-{month:02d}-{day:02d} {rng.randrange(4):02d}:{rng.randrange(60):02d}"))
    df = spark.createDataFrame(rows, "arquivo_id bigint, linha int, created_at string")
    z = spark.createDataFrame(list(enumerate(zones)), "arquivo_id bigint, fuso string")
    for r in instants.to_instants(df, z).collect():
        a = dt.datetime.strptime(r.created_at, "%Y-%m-%d %H:%M").replace(tzinfo=zoneinfo.ZoneInfo(zones[r.arquivo_id]))
        # fold 0 takes the first of two and, in a gap, the offset before it
        assert r.instante_us == round(a.timestamp() * 1e6), (r.created_at, zones[r.arquivo_id])


def test_instants_outside_the_table_of_intervals(spark):
    rows = [("1931-10-05 12:00", "America/Sao_Paulo"), ("1969-12-31 23:30", "Europe/Lisbon"), ("1947-04-13 02:30", "Europe/Berlin"), ("2150-07-01 12:00", "America/New_York"), ("2150-01-01 12:00", "Asia/Tokyo"), ("1900-01-01 00:00Z", "UTC")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "arquivo_id bigint, created_at string")
    z = spark.createDataFrame([(i, n) for i, (_, n) in enumerate(rows)], "arquivo_id bigint, fuso string")
    for r in instants.to_instants(df, z).collect():
        t, zone = rows[r.arquivo_id]
        a = dt.datetime.strptime(t.removesuffix("Z"), "%Y-%m-%d %H:%M").replace(tzinfo=zoneinfo.ZoneInfo(zone))
        assert r.instante_us == round(a.timestamp() * 1e6) and r.situacao == ("explicita" if t.endswith("Z") else "fora_da_tabela"), r


# -- skew


def test_salts_follow_the_share_of_a_key(spark):
    d = spark.createDataFrame([(1,)] * 500 + [(2,)] * 100 + [(k,) for k in range(10, 410)], "k int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        assert {r.k: r._sais for r in skew.hot_keys(d, "k").collect()} == {1: 100, 2: 20}
        spark.conf.set("spark.sql.shuffle.partitions", "1000")
        assert {r.k: r._sais for r in skew.hot_keys(d, "k").where("k < 5").collect()} == {1: 1000, 2: 200}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert skew.heavy_accounts(spark.createDataFrame([], "destino_conta_id int, origem_conta_id int")).count() == 0


def test_salted_join_and_eager_aggregate(spark):
    rng = random.Random(2)
    left = [(None if rng.random() < 0.05 else 1 if rng.random() < 0.4 else rng.randrange(60), i) for i in range(3000)]
    right = [(k, k * 10) for k in range(0, 60, 2)]
    a, b = spark.createDataFrame(left, "k int, v int"), spark.createDataFrame(right + [(None, 1)], "k int, w int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        got = sorted(map(str, skew.salted_join(a, b, "k", how=how).collect()))
        assert got == sorted(map(str, a.join(b, "k", how).collect()))
    assert skew.salted_join(a.limit(0), b, "k").count() == 0
    m = spark.createDataFrame([(rng.randrange(70),) for _ in range(500)], "conta_id int")
    e = a.withColumnRenamed("k", "destino_conta_id").select("destino_conta_id", (F.col("v") % 13).alias("origem_conta_id"), (F.col("v") % 5).alias("data"), F.lit(2).alias("peso"), F.lit(1).alias("mencoes"))
    got = {r.destino_conta_id: r for r in skew.accounts(e, m).collect()}
    joined = e.drop("mencoes").join(m, e.destino_conta_id == m.conta_id).groupBy("destino_conta_id").agg(F.count("*").alias("n"), F.sum("peso").alias("s")).collect()
    assert {r.destino_conta_id: (r.n, r.s) for r in joined} == {k: (r.pares, r.peso_pares) for k, r in got.items() if r.pares}
    assert None not in got and sum(r.arestas for r in got.values()) == sum(k is not None for k, _ in left)
    assert [r[0] for r in skew.heavy_accounts(e, 0.2).collect()] == [1]


# -- nesting


def brute_mentions(payload):
    out, post, depth = set(), json.loads(payload), 0
    while isinstance(post, dict):
        holder = post["legacy"]["entities"].get("user_mentions") if "legacy" in post else post.get("mentions")
        for i, m in enumerate(holder if isinstance(holder, list) else [holder] if holder else []):
            h = (m or {}).get("screen_name") or (m or {}).get("username") or (m or {}).get("handle")
            if h:
                out.add((depth, i, h.lower()))
        q = post.get("quoted_status_result", post.get("quoted"))
        q = q.get("result", q) if q else None
        post, depth = (q.get("tweet", q) if q else None), depth + 1
        if isinstance(post, dict) and not ({"legacy", "id"} & set(post)):
            post = None
    return out


def test_mentions_and_identities(spark):
    m = lambda h: {"id_str": "1", "screen_name": h}
    inner = gql(entities={"user_mentions": [m("Zé"), None, m(None), m("zé")], "hashtags": [{"text": "A"}]})
    outer = gql(entities={"user_mentions": m("Só"), "hashtags": []}) | {"quoted_status_result": {"result": inner | {"quoted_status_result": {}}}}
    deep = cons(mentions=[{"username": "x"}, {"handle": "Y"}])
    for _ in range(60):
        deep = cons(mentions=[{"username": "p"}], quoted=deep)
    texts = [json.dumps(outer), json.dumps(inner), json.dumps(outer), json.dumps(deep), json.dumps(cons(quoted=None)), None, "", "{", "[]", json.dumps(gql() | {"quoted_status_result": {"result": {"__typename": "X"}}})]
    df = spark.createDataFrame([(1, i, t, "c", "h") for i, t in enumerate(texts)] + [(1, 0, texts[0], "c", "h")], "arquivo_id bigint, linha int, payload string, conteudo string, handle string")
    want = {(1, i, *x) for i, t in enumerate(texts) if t and t[0] == "{" and t != "{" for x in brute_mentions(t)}
    assert {tuple(r) for r in nested.mentions(df).collect()} == want and len(want) > 60
    bridges, objects = nested.split(df)
    b = bridges.collect()
    hashes = {r.objeto for r in objects.collect()}
    assert all(r.objeto in hashes for r in b) and len(hashes) == objects.count()
    # the quoted post is the same object as the one delivered alone but for its empty quote slot
    posts = {(r.linha, r.profundidade): (bytes(r.objeto), r.pai) for r in b if r.tipo == "postagem"}
    assert posts[0, 1][0] == posts[1, 0][0] and posts[0, 0][0] == posts[2, 0][0] and bytes(posts[0, 1][1]) == posts[0, 0][0]
    assert nested.mentions(df.limit(0)).count() == 0


def test_quotes_below_limited_wrappers(spark):
    m = lambda h: {"user_mentions": [{"id_str": "1", "screen_name": h}], "hashtags": [{"text": h}]}
    wrap = lambda inner: {"quoted_status_result": {"result": {"limited": {"acao": 1}, "tweet": inner}}}
    gone = {"quoted_status_result": {"result": {"tombstone": {"text": "x"}}}}
    low = gql(entities=m("C"))
    rows = [gql(entities=m("A")) | wrap(gql(entities=m("B")) | wrap(low)), low, gql(entities=m("A")) | {"quoted_status_result": {"result": low}}, low | gone]
    df = spark.createDataFrame([(1, i, json.dumps(r)) for i, r in enumerate(rows)], "arquivo_id bigint, linha int, payload string")
    want = {(1, 0, 0, 0, "a"), (1, 0, 1, 0, "b"), (1, 0, 2, 0, "c"), (1, 1, 0, 0, "c"), (1, 2, 0, 0, "a"), (1, 2, 1, 0, "c"), (1, 3, 0, 0, "c")}
    assert {tuple(r) for r in nested.mentions(df).collect()} == want == {tuple(r) for r in nested.hashtags(df).collect()}
    posts = {(r.linha, r.profundidade): r for r in nested.posts(df).collect()}
    assert len(posts) == 7 and posts[0, 2].objeto == posts[1, 0].objeto == posts[2, 1].objeto and posts[0, 2].pai == posts[0, 1].objeto
    # neither the mark of the wrapper nor an unavailable post is lost
    contents = [r.conteudo for r in nested.split(df)[1].where("tipo = 'postagem'").collect()]
    assert sum('"limited":{"acao":1}' in c for c in contents) == 2 and sum("tombstone" in c for c in contents) == 1


def test_unreadable_records_are_named(spark):
    deep = '{"id": "1", "quoted": ' * 60_000 + "1" + "}" * 60_000
    texts = [json.dumps(gql()), None, " ", "{", "[1]", "3", deep]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "arquivo_id bigint, linha int, payload string")
    assert {r.linha: r.motivo for r in nested.unreadable(df).collect()} == {1: "vazio", 2: "vazio", 3: "json", 4: "nao_objeto", 5: "nao_objeto", 6: "profundo"}
    assert {r.linha for r in nested.posts(df).collect()} == {0}


LIMITED = r"""
WITH RECURSIVE p AS (
  SELECT arquivo_id, linha, 0 AS profundidade, CAST(payload AS JSON) AS j FROM registro
  UNION ALL
  SELECT arquivo_id, linha, profundidade + 1, q
  FROM (SELECT arquivo_id, linha, profundidade, coalesce(j->'$.quoted_status_result.result.tweet', j->'$.quoted_status_result.result', j->'$.quoted') AS q FROM p)
  WHERE json_type(q) = 'OBJECT' AND ((q->'$.legacy') IS NOT NULL OR (q->'$.id') IS NOT NULL)),
l AS (SELECT arquivo_id, linha, profundidade, coalesce(j->'$.legacy.entities.user_mentions', j->'$.mentions') AS m FROM p),
e AS (SELECT arquivo_id, linha, profundidade, CASE WHEN json_type(m) = 'ARRAY' THEN CAST(m AS JSON[]) WHEN json_type(m) = 'OBJECT' THEN [m] END AS a FROM l),
x AS (SELECT arquivo_id, linha, profundidade, unnest(a) AS item, generate_subscripts(a, 1) - 1 AS posicao FROM e),
mencoes AS (SELECT DISTINCT arquivo_id, linha, profundidade, posicao, item->>'$.id_str' AS id_nativo, lower(coalesce(item->>'$.screen_name', item->>'$.username', item->>'$.handle')) AS handle
  FROM x WHERE json_type(item) <> 'NULL')
"""


def limited(columns):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW registro AS SELECT * FROM read_parquet('{SF}/registro.parquet')")
    return set(con.execute(f"{LIMITED} {columns}").fetchall())


def test_mentions_of_the_tables_against_sql_with_wrappers(spark):
    want = limited("SELECT arquivo_id, linha, profundidade, posicao, handle FROM mencoes WHERE handle IS NOT NULL")
    assert {tuple(r) for r in nested.mentions(spark.read.parquet(f"{SF}/registro.parquet")).collect()} == want


def test_flat_tables_hold_every_record(spark):
    """Bridges and objects against the payloads, taken apart by other means; mentions and hashtags against both."""
    q = data_problems.QUERIES
    bridges = q["p6_pontes"](spark, SMALL).collect()
    objects = {r.objeto: (r.tipo, r.conteudo) for r in q["p6_objetos"](spark, SMALL).collect()}
    payloads = {}
    for a, line, text in duckdb.sql(f"SELECT arquivo_id, linha, payload FROM '{SMALL}/registro.parquet'").fetchall():
        try:
            v = json.loads(text) if text else None
        except ValueError:
            v = None
        if isinstance(v, dict):
            payloads[a, line] = v
    want = {}
    for key, post in payloads.items():
        depth = 0
        while post:
            holder = post["legacy"].get("entities") or {} if "legacy" in post else post
            for kind, name in (("mencao", "user_mentions" if "legacy" in post else "mentions"), ("hashtag", "hashtags")):
                items = holder.get(name)
                items = items.replace(",", " ").replace(";", " ").split() if isinstance(items, str) and kind == "hashtag" else items if isinstance(items, list) else [items]
                want |= {(*key, kind, depth, i): x for i, x in enumerate(items) if x is not None}
            want[(*key, "postagem", depth, 0)] = {k: v for k, v in post.items() if k not in ("legacy", "mentions", "hashtags", "quoted", "quoted_status_result")}
            below = post.get("quoted") or (post.get("quoted_status_result") or {}).get("result")
            below = below.get("tweet", below) if below else None
            post, depth = below if below and ("legacy" in below or "id" in below) else None, depth + 1
    got = {}
    for r in bridges:
        tipo, text = objects[r.objeto]
        v = json.loads(text)
        if tipo == "postagem":
            v = {k: x for k, x in v.items() if k not in ("legacy", "quoted", "quoted_status_result", "@filhos", "@cita")}
        assert tipo == r.tipo and (r.pai is None) == (r.tipo == "postagem" and r.profundidade == 0)
        got[r.arquivo_id, r.linha, r.tipo, r.profundidade, r.posicao] = v
    assert got == want and len(got) == len(bridges) and {r.objeto for r in bridges} == set(objects)
    post = {(r.arquivo_id, r.linha, r.profundidade): r.objeto for r in bridges if r.tipo == "postagem"}
    assert all(r.pai == post.get((r.arquivo_id, r.linha, r.profundidade - (r.tipo == "postagem"))) for r in bridges)
    mentions, tags = q["p6_tabela_mencoes"](spark, SMALL).collect(), q["p6_tabela_hashtags"](spark, SMALL).collect()
    for kind, rows in (("mencao", mentions), ("hashtag", tags)):
        place = lambda r: (r.arquivo_id, r.linha, r.profundidade, r.posicao, r.pai, r.objeto)
        assert sorted(map(place, rows)) == sorted(place(r) for r in bridges if r.tipo == kind)
    name = lambda x: next((x[k] for k in ("screen_name", "username", "handle") if x.get(k) is not None), None)
    for r in mentions:
        x = want[r.arquivo_id, r.linha, "mencao", r.profundidade, r.posicao]
        assert (r.id_nativo, r.handle) == ((x.get("id_str"), name(x) and name(x).lower()) if isinstance(x, dict) else (None, x.lower()))
    for r in tags:
        x = want[r.arquivo_id, r.linha, "hashtag", r.profundidade, r.posicao]
        x = x.get("text") if isinstance(x, dict) else x
        assert r.hashtag == (x and x.lower())
    assert any(r.handle is None for r in mentions) and any(r.id_nativo for r in mentions)


# -- references


def test_references_by_reason(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    conta = spark.createDataFrame([(1, t(1)), (2, t(20)), (3, None), (None, t(1))], "conta_id bigint, criado_em timestamp_ntz")
    cols = "postagem_id bigint, id_nativo string, created_at timestamp_ntz, carregada_em timestamp_ntz, ref_conta_id bigint, ref_id_nativo string, situacao string, chave string, periodo string"
    P = lambda i, n, load, rc, rn, s="ativa": (i, n, t(5), load, rc, rn, s, "x", "x")
    posts = spark.createDataFrame(
        [P(10, "0100", t(6), 1, " 100\t"), P(11, "101", t(6), 2, "000101"), P(12, "102", t(6), 9, "999", "deletada"), P(13, "103", t(2), 3, "102"), P(14, "104", t(3), -1, "101"), P(15, None, None, 0, "0"), P(16, "", t(6), None, " "), P(17, "7", t(6), None, "-1"), P(17, "7", t(6), None, "-1")],
        cols,
    )
    men = spark.createDataFrame([(1, 10, 1), (2, 10, 2), (3, 10, 8), (4, 99, 8), (5, 10, None), (6, 15, 2), (6, 15, 2)], "mencao_id bigint, postagem_id bigint, conta_id bigint")
    got = {tuple(r) for r in references.orphan_references(men, posts, conta).collect()}
    day = "2024-01-05"
    assert got == {
        ("mencao", "conta_id", 2, day, "tardia"), ("mencao", "conta_id", 3, day, "ausente"), ("mencao", "conta_id", 4, None, "ausente"),
        ("postagem", "ref_conta_id", 11, day, "tardia"), ("postagem", "ref_conta_id", 12, day, "ausente"),
        ("postagem", "ref_id_nativo", 12, day, "ausente"), ("postagem", "ref_id_nativo", 13, day, "apagada"), ("postagem", "ref_id_nativo", 14, day, "tardia"),
    }
    assert references.orphan_references(men.limit(0), posts.limit(0), conta).count() == 0
