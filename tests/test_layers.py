"""Pipeline layers on hand fixtures: bronze files, gate, table changes, star schema edge cases, constraints, labels, sinks, streaming."""

import datetime as dt
import hashlib
import io
import json
import types

import pytest
from pyspark.sql import functions as F

from estuario.functions.text import clean_text
from estuario.operators import constraints, dml, gold, labels, qc, ruler, silver
from estuario.plans import pipeline
from estuario.queries import layers, quality
from estuario.session import table
from estuario.sources import bronze, sinks
from estuario.streaming import windows

SF = "/root/testdata/sf0.001"


def test_ingest_twice_is_idempotent(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"metadata": {"query": "(tema) since:2024-01-01", "since": "2024-01-01", "until": "2024-01-02"}, "tweets": [{"á": 1}, {"b": [1, 2]}]}, ensure_ascii=False))
    (tmp_path / "b.json").write_text((tmp_path / "a.json").read_text())  # same content, other name
    (tmp_path / "c.jsonl").write_text('\n {"x":1} \n\n{"x":2}\n')
    (tmp_path / "vazio.json").write_text('{"metadata": {}, "tweets": []}')
    (tmp_path / "nota.txt").write_text("x")
    none = spark.createDataFrame([], "sha256 string")
    files, records = bronze.ingest(spark, str(tmp_path), "caso", "graphql", none)
    rows = {(r.linha, r.payload) for r in records.collect()}
    assert rows == {(1, '{"á":1}'), (2, '{"b":[1,2]}'), (1, '{"x":1}'), (2, '{"x":2}')}
    f = files.collect()
    assert len(f) == 2 and {r.consulta for r in f} == {"(tema)", None} and all(r.arquivo_id > 0 for r in f)
    again, more = bronze.ingest(spark, str(tmp_path), "caso", "graphql", files)
    assert {r.formato for r in again.collect()} <= {"json"} and again.count() == 0 and more.count() == 0
    with pytest.raises(FileNotFoundError):
        (tmp_path / "so").mkdir()
        bronze.inventory(spark, str(tmp_path / "so"), "c", "g")


def test_ingest_keeps_files_with_blanks_and_accents(spark, tmp_path):
    names = ["dia 1.json", "dia2.json", "ação+1%.json", "x y.jsonl"]
    for i, n in enumerate(names):
        (tmp_path / n).write_text(json.dumps({"metadata": {}, "tweets": [{"n": i}]}) if n.endswith("json") else json.dumps({"n": i}))
    (tmp_path / "vazio 2.json").write_text('{"metadata": {}, "tweets": []}')
    (tmp_path / "torto.json").write_text("{")
    files, records = bronze.ingest(spark, str(tmp_path), "c", "g", spark.createDataFrame([], "sha256 string"))
    assert files.count() == 4 and {json.loads(r.payload)["n"] for r in records.collect()} == {0, 1, 2, 3}
    got = {r.uri: (r.sha256, r.bytes) for r in bronze.inventory(spark, str(tmp_path), "c", "g").collect()}
    want = {(hashlib.sha256(p.read_bytes()).hexdigest(), p.stat().st_size) for p in tmp_path.iterdir()}
    assert set(got.values()) == want and len(got) == 6
    assert {r.uri.rsplit("/", 1)[1] for r in bronze.without_records(spark, str(tmp_path)).collect()} == {"vazio%202.json", "torto.json"}


def test_containers_are_read_as_streams():
    """Against the standard reader, cut into blocks of every small size."""
    doc = {"x": [1, {"tweets": [9]}], "metadata": {"query": "á", "since": None}, "n": 12.50, "tweets": [{"á": "\u2028é😀", "n": 1e3}, {}, 7, [1, "]"], None, {"b": {"c": ["}"]}}], "z": -0.5, "fim": "tweets"}
    for raw in (json.dumps(doc, ensure_ascii=False), json.dumps(doc, indent=2), "\ufeff" + json.dumps(doc), json.dumps(dict(reversed(doc.items())))):
        for block in (1, 2, 3, 7, 1000):
            class Small(io.BytesIO):
                def read(self, n=-1):
                    return super().read(min(n, block) if n > 0 else n)  # noqa: B023

            got = list(bronze._container(Small(raw.encode())))
            assert [v for k, v in got if k == "tweet"] == doc["tweets"] and [v for k, v in got if k == "metadata"] == [doc["metadata"]]
    for bad in ("", "{", "[]", '{"tweets": [1, 2', '{"tweets": [1 2]}', '{"tweets" [1]}'):
        with pytest.raises(ValueError):
            list(bronze._container(io.BytesIO(bad.encode())))
    assert list(bronze._container(io.BytesIO(b'{"tweets": {}}'))) == [] == list(bronze._container(io.BytesIO(b"{}")))


def test_metadata_behind_the_records_and_broken_containers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"tweets": [{"n": i} for i in range(2500)], "metadata": {"query": "q since:1", "since": "2024-01-01", "until": "x"}}))
    r = bronze.read_container(spark, str(tmp_path)).collect()
    assert sorted(x.linha for x in r) == list(range(1, 2501)) and {(x.consulta, x.periodo_inicio, x.periodo_fim) for x in r} == {("q", dt.date(2024, 1, 1), None)}
    (tmp_path / "b.json").write_text('{"metadata": {}, "tweets": [{"n": 1}, {"n": ')
    with pytest.raises(Exception, match="breaks off after record 1"):
        bronze.read_container(spark, str(tmp_path)).collect()


def test_label_files(spark, tmp_path):
    (tmp_path / "treino.jsonl").write_text('{"id": 1, "case": "c", "text": "a", "clean_text": "[IRONY] a", "stance": "neutro"}\n{"id": 2}\n')
    (tmp_path / "teste.json").write_text('[{"id": 3,\n "case": "c"}]')
    assert {(r.id, r.arquivo, r.stance) for r in bronze.label_files(spark, str(tmp_path)).collect()} == {("1", "treino.jsonl", "neutro"), ("2", "treino.jsonl", None)}
    assert [(r.id, r.arquivo) for r in bronze.label_files(spark, str(tmp_path), "*.json", multiline=True).collect()] == [("3", "teste.json")]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text("".join(f'{{"n":{i}}}\n' + "\n" * (i % 3) for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        d = bronze.read_lines(spark, str(tmp_path))
        assert d.rdd.getNumPartitions() >= 1
        rows = d.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5000 and all(json.loads(r.payload)["n"] == r.linha - 1 for r in rows)


def test_clean_text(spark):
    s = "Olá mundo https://t.co/x @ana_b #Tag_1 fim  www.a.b\tpic.twitter.com/z"
    more = {"httpsss://x y": "y", "http… z": "z", "wwwexemplo.com a": "a", "b pic.twitter.com": "b pic.twitter.com", "pic.twitter.com/k c": "c", "@é d": "@é d", "@abcdefghijklmnopq": "pq", "a\u00a0\u00a0b": "a b"}
    got = spark.createDataFrame([(t,) for t in more], "t string").select("t", clean_text(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == more
    assert spark.createDataFrame([(s,), (None,)], "t string").select(clean_text(F.col("t")).alias("c")).collect()[0].c == "Olá mundo fim"


def test_cleaning_rule_gives_every_stored_text(spark):
    for d in (SF, "/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = quality.QUERIES["v1_cleaning_oracle"](spark, d).collect()
        assert rows and all(r.parcela == 1.0 and r.iguais == r.postagens for r in rows), (d, rows)


CAP = "caso_slug string, id_nativo string, arquivo_id bigint, linha int, autor_handle string, created_at timestamp_ntz, texto string, idioma string, ref_handle string, tipo_ref string, likes int, retweets int, quotes int, respostas int, mencoes array<struct<id_nativo:string,handle:string>>, stance_previa string"


def cap(**k):
    base = {"caso_slug": "c", "id_nativo": "1" * 16, "arquivo_id": 1, "linha": 1, "autor_handle": "a", "created_at": dt.datetime(2024, 1, 2), "texto": "t", "idioma": "pt", "ref_handle": None, "tipo_ref": "original", "likes": 1, "retweets": 0, "quotes": 0, "respostas": 0, "mencoes": [], "stance_previa": None}
    return tuple((base | k).values())


BAD = {
    "qc_duplicatas_divergentes": [cap(), cap(linha=2, likes=5)], "qc_id_fora_do_padrao": [cap(id_nativo="12\n")], "qc_descartadas_sem_autor": [cap(autor_handle=" ")], "qc_pct_sem_autor": [cap(autor_handle=None)], "qc_data_nao_parseada": [cap(created_at=None)],
    "qc_fora_da_janela": [cap(created_at=dt.datetime(2024, 2, 9))], "qc_data_no_futuro": [cap(created_at=dt.datetime(2030, 1, 1))], "qc_reply_sem_destino": [cap(tipo_ref="reply")], "qc_contador_negativo": [cap(quotes=-1)],
    "qc_texto_vazio": [cap(texto="")], "qc_idioma_inesperado": [cap(idioma="en")], "qc_pct_mencoes_com_id": [cap(mencoes=[(None, "x")])], "qc_stance_previa_fora_do_dominio": [cap(stance_previa="talvez")],
}


@pytest.mark.parametrize("indicator", BAD)
def test_each_indicator_fails_alone(spark, indicator):
    caps = spark.createDataFrame(BAD[indicator], CAP)
    per = spark.createDataFrame([("c", dt.date(2024, 1, 1), dt.date(2024, 1, 3)), ("c", None, dt.date(2024, 1, 3))], "caso_slug string, periodo_inicio date, periodo_fim date")
    out = {r.indicador: r for r in qc.battery(caps, silver.deduplicate(caps), per, "v", "2024-06-01 00:00:00").collect()}
    assert len(out) == 21 and not out[indicator].aprovado
    blocking = {k for k, r in out.items() if not r.aprovado and r.severidade == "bloqueia"}
    g = qc.gate(spark.createDataFrame(list(out.values())))
    assert g.first().pode_promover == (not blocking)
    if blocking:
        with pytest.raises(RuntimeError):
            qc.require(g, "c", "v")
    with pytest.raises(RuntimeError):
        qc.require(g, "c", "outra")


def test_indicators_after_promotion(spark):
    oracle = spark.createDataFrame([(1, "a", "a"), (2, "b", "[IRONY] b"), (3, "c", "x"), (9, "z", "z"), (4, None, None)], "id bigint, text string, clean_text string")
    posts = spark.createDataFrame([(10, "1", "c", "a", "a"), (20, "2", "c", "b", "b"), (30, "3", "d", "C", "c"), (40, "4", "d", None, None)], "postagem_id bigint, id_nativo string, caso_slug string, texto string, texto_limpo string")
    pairs = qc.cleaning_pairs(oracle, posts)
    assert {r.id: (r.caso_slug, r.marcado, r.texto_igual, r.limpo_igual) for r in pairs.collect()} == {"1": ("c", False, True, True), "2": ("c", True, True, True), "3": ("d", False, False, False), "9": (None, False, False, False), "4": ("d", False, True, True)}
    assert {r.caso_slug: (r.pares, r.textos_iguais, r.marcados, r.limpos_iguais) for r in qc.cleaning_summary(pairs).collect()} == {"c": (2, 2, 1, 2), "d": (2, 1, 0, 1), None: (1, 0, 0, 0)}
    lab = spark.createDataFrame([(10, "m", "1", "neutro"), (20, "m", "1", "acusador"), (20, "m", "2", "neutro"), (30, "m", "1", "acusador")], "postagem_id bigint, modelo string, versao string, rotulo string")
    tested = spark.createDataFrame([("c", "neutro", "neutro"), ("c", "neutro", "acusador")], "caso_slug string, verdade string, previsto string")
    out = {(r.caso_slug, r.indicador.removeprefix("qc_")): (r.valor, r.aprovado, r.severidade) for r in qc.after_promotion(pairs, posts, lab, tested, "m", "1", "v", "2024-01-01 00:00:00").collect()}
    assert out == {
        ("c", "texto_limpo_reproduz_oraculo"): (100.0, True, "bloqueia"), ("d", "texto_limpo_reproduz_oraculo"): (50.0, False, "bloqueia"),
        ("c", "classificacao_cobertura"): (100.0, True, "informa"), ("d", "classificacao_cobertura"): (50.0, True, "informa"),
        ("c", "classificacao_pct_neutro"): (50.0, True, "alerta"), ("d", "classificacao_pct_neutro"): (0.0, False, "alerta"), ("c", "classificador_acuracia_teste"): (0.5, False, "alerta"),
    }
    assert qc.after_promotion(pairs.limit(0), posts.limit(0), lab, tested.limit(0), "m", "1", "v", "2024-01-01 00:00:00").count() == 0


def test_dedup_takes_first_and_greatest(spark):
    rows = [cap(arquivo_id=2, linha=1, texto="b", likes=9), cap(arquivo_id=1, linha=7, texto=None, likes=2), cap(arquivo_id=1, linha=8, texto="c", likes=None)]
    r = silver.deduplicate(spark.createDataFrame(rows, CAP)).collect()
    assert len(r) == 1 and r[0].texto is None and r[0].likes == 9 and r[0].capturas == 3


def test_upsert_and_friends(spark):
    t, s = spark.createDataFrame([("a", None, 1), ("b", "x", 2), (None, "n", 3)], "k string, v string, w int"), spark.createDataFrame([("a", "y", 9), ("b", "z", 9), ("c", "q", 9), (None, "m", 9)], "k string, v string, w int")
    assert {tuple(r) for r in dml.upsert(t, s, ["k"], ["v"]).collect()} == {("a", "y", 1), ("b", "x", 2), ("c", "q", 9), (None, "n", 3)}
    assert {r.k for r in dml.insert_only(t.dropna(), s.dropna(), ["k"]).collect()} == {"a", "b", "c"}
    assert dml.keep_first(s.unionAll(s), ["k"], ["w", "v"]).count() == 4
    assert {r.v for r in dml.replace_groups(t.dropna(), s.where("k = 'b'"), ["k"]).collect()} == {"z"}


def test_update_quarantine_and_views(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, None, "w")], "id int, k string, v string")
    assert [(r.id, r.v) for r in dml.update(t, v=F.upper("v"), id=F.col("id") * 2).orderBy("id").collect()] == [(2, "X"), (4, "Y"), (6, "Z"), (8, "W")]
    kept, aside = dml.quarantine(t, ["k"], ["id"])
    assert {r.id for r in kept.collect()} == {1, 3} and {r.id for r in aside.collect()} == {2, 4} and kept.columns == t.columns
    dml.create_view(t, "v_teste", {"v": "um valor"})
    got = spark.table("v_teste")
    assert got.schema["v"].metadata == {"comment": "um valor"} and got.schema["k"].metadata == {} and got.count() == 4


def test_checkpoint_folder_and_partitions(spark):
    from estuario import session

    assert session.partitions_for(0, 8) == 8 and session.partitions_for(10 << 30, 8) == 160 and session.partitions_for(100 << 40, 200) == 50_000 and session.partitions_for(100 << 40, 60_000) == 60_000
    kept = session.keep(spark.range(5), "t")
    assert kept.count() == 5 and session.forget(spark) > 0 and session.forget(spark) == 0
    # a folder of one machine is no place to keep data on a cluster
    far = types.SimpleNamespace(sparkContext=types.SimpleNamespace(master="spark://elsewhere:7077"), conf=types.SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch(far, "t")


def test_reconciliation_names_what_differs(spark):
    posts = spark.createDataFrame([("c",), ("c",), ("so_aqui",)], "caso_slug string")
    p = pairs(spark, [(2, 1), (3, 1)])
    act, net = spark.createDataFrame([("c", 2)], "caso string, n_postagens bigint"), spark.createDataFrame([("c", 3, 2)], "caso string, n_mencoes bigint, n_arestas bigint")
    e, n = spark.createDataFrame([("c", 1, "alvo"), ("c", 1, "demais")], "caso string, peso bigint, papel_origem string"), spark.createDataFrame([("c", "n1"), ("c", "n1")], "caso string, id string")
    bad = {(r.verificacao, r.caso): (r.esquerda, r.direita) for r in gold.reconciliation(posts, p, act, net, e, n).where("NOT confere").collect()}
    assert bad == {("postagens", "so_aqui"): (0, 1), ("mencoes_rede", "c"): (3, 2), ("alvo_como_origem", "c"): (1, 0), ("pseudonimo_unico", "c"): (1, 2)}


DAY = dt.date(2024, 1, 1)


def pairs(spark, es):
    return spark.createDataFrame([("c", DAY, i, a, b) for i, (a, b) in enumerate(es)], "caso string, data date, postagem_id bigint, origem bigint, destino bigint")


def test_network_extremes(spark):
    cases = spark.createDataFrame([("c", "2024-01-01", 1)], "caso string, estopim string, alvo_conta_id bigint")
    one = gold.network(pairs(spark, [(1, 1)]), cases).first()
    assert one.n_nos == 1 and one.densidade is None and one.centralizacao_grau_entrada is None and one.isolamento_alvo == 1
    two = gold.network(pairs(spark, [(2, 1), (2, 1)]), cases).first()
    assert two.n_nos == 2 and two.n_arestas == 1 and two.n_mencoes == 2 and two.densidade == 0.5
    star = gold.network(pairs(spark, [(i, 1) for i in range(2, 12)]), cases).first()
    assert star.centralizacao_grau_entrada == 1 and star.hhi_mencoes_recebidas == 1
    assert gold.network(pairs(spark, [(1, 2)]).limit(0), cases).count() == 0


def test_calendar_phases_and_tie(spark):
    n = {-1: 2, 0: 3, 1: 8, 2: 20, 3: 20, 4: 6, 5: 5, 6: 4}
    posts = spark.createDataFrame([("c", dt.datetime(2024, 1, 10, 5) + dt.timedelta(days=d)) for d, k in n.items() for _ in range(k)] + [("c", None)], "caso_slug string, created_at timestamp_ntz")
    cases = spark.createDataFrame([("c", dt.date(2024, 1, 10))], "caso string, estopim date")
    got = {r.dias_desde_estopim: r.fase for r in gold.calendar(posts, cases).collect()}
    assert got == {-1: "pre_crise", 0: "estopim", 1: "escalada", 2: "pico", 3: "declinio", 4: "declinio", 5: "declinio", 6: "pos_rito"}


def test_modal_tie_and_versions(spark):
    d = spark.createDataFrame([("k", "b"), ("k", "a"), ("m", "z"), ("m", "z"), ("m", "a")], "k string, v string")
    assert {tuple(r) for r in gold.modal(d, ["k"], "v", "m").collect()} == {("k", "a"), ("m", "z")}
    posts = spark.createDataFrame([(1, "c", dt.datetime(2024, 1, 1), 5, "1", None, None)], "postagem_id bigint, caso_slug string, created_at timestamp_ntz, autor_conta_id bigint, id_nativo string, tipo_ref string, ref_conta_id bigint")
    lab = spark.createDataFrame([(1, "neutro", "v1"), (1, "acusador", "v2")], "postagem_id bigint, rotulo string, versao string")
    assert [r.stance for r in gold.labelled(posts, lab, "v2").collect()] == ["acusador"]
    assert [r.stance for r in gold.labelled(posts, lab, "v3").collect()] == ["sem_rotulo"]


RULES = {
    "arquivo": ("bytes bigint, sha256 string, formato string, periodo_inicio date, periodo_fim date", (1, "a" * 64, "json", None, DAY), (0, "A" * 64, "csv", DAY + dt.timedelta(1), DAY)),
    "registro": ("linha int, payload string", (1, "{}"), (0, "[]")),
    "postagem": ("idioma string, tipo_ref string, situacao string, ref_conta_id bigint, ref_id_nativo string", (None, "reply", "ativa", 3, None), ("PT", "reply", "apagada", None, None)),
    "v_deduplicado": ("likes int, retweets int, quotes int, respostas int, stance_previa string", (0, 0, 0, 0, None), (0, -1, 0, 0, "x")),
    "postagem_hashtag": ("hashtag string", ("a",), ("A",)),
    "classificacao": ("confianca double, rotulo string", (1.0, "neutro"), (1.1, "x")),
    "papel_narrativo": ("papel_final string, dia_virada int", (None, None), ("x", None)),
    "qc_resultado": ("severidade string", ("alerta",), ("grave",)),
    "captura": ("likes int, retweets int, quotes int, respostas int, engajamento int", (1, 2, 3, 4, 10), (1, 2, 3, 4, 9)),
    "lapide": ("situacao string, removida_em timestamp_ntz", ("ativa", None), ("deletada", None)),
    "contribuinte": ("consentiu boolean, consentiu_em timestamp_ntz", (False, None), (True, None)),
    "auditoria": ("acao string", ("inserir",), ("olhar",)),
    "pais": ("pais string", ("BR",), ("br",)),
    "vinculo": ("ator_id bigint, criterio string", (None, None), (1, None)),
}


@pytest.mark.parametrize("name", RULES)
def test_constraints_hold_and_fail(spark, name):
    schema, good, bad = RULES[name]
    assert constraints.require_valid(spark.createDataFrame([good], schema), name).count() == 1
    with pytest.raises(ValueError):
        constraints.require_valid(spark.createDataFrame([good, bad], schema), name)


def test_unique_rules(spark):
    d = spark.createDataFrame([("x", None), ("x", None), ("x", "1"), ("x", "1"), ("y", "1")], "p string, n string")
    assert {r.n for r in constraints.not_unique(d, ["p", "n"]).collect()} == {None, "1"}
    assert {r.n for r in constraints.not_unique(d, ["p", "n"], nulls_equal=False).collect()} == {"1"}


def test_labels(spark):
    posts = spark.createDataFrame([(1, "ele negou tudo"), (2, " "), (3, None), (4, "apoiou e salvou"), (5, "nada")], "postagem_id bigint, texto_limpo string")
    none = spark.createDataFrame([], "postagem_id bigint, modelo string, versao string")
    got = labels.score(labels.pending(posts, none, "m", "1"), labels.lexicon_scorer, "m", "1")
    assert {r.postagem_id: r.rotulo for r in got.collect()} == {1: "acusador", 4: "defensor", 5: "neutro"}
    assert labels.pending(posts, got, "m", "1").count() == 0 and labels.pending(posts, got, "m", "2").count() == 3
    assert labels.score(posts.limit(0), labels.lexicon_scorer, "m", "1").count() == 0


def test_pipeline_composes_and_hides_accounts(spark):
    src = {t: table(spark, SF, t) for t in ("arquivo", "registro", "fuso_arquivo", "conta")}
    out = pipeline.run(spark, src, pipeline.Params("v1", "sal", "2025-01-01 00:00:00"))
    assert out["gate"].count() == src["arquivo"].select("caso_slug").distinct().count()
    assert not {"texto", "autor_handle", "origem_conta_id", "conta_id", "handle"} & set(out["v_grafo_arestas"].columns + out["v_grafo_nos"].columns)
    ok = out["gate"].withColumn("pode_promover", F.lit(True))
    assert silver.promotable(out["postagem"], ok, "v2").count() == 0


def test_ruler_and_folders(spark, tmp_path):
    d = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    a = ruler.measures(d, "t", "k", n="count(*)", s="sum(v)")
    b = ruler.measures(d.where("v < 3").withColumn("v", F.col("v") * 2), "t", "k", n="count(*)", s="sum(v)")
    assert ruler.drifted(a, a).count() == 0 and ruler.drifted(a, b).count() == 4
    for x in "xy":
        sinks.write_csv(d.repartition(3), str(tmp_path / x), order=["v"])
    names = {p.name for x in "xy" for p in (tmp_path / x).glob("part*")}
    for x in "xy":
        next((tmp_path / x).glob("part*")).rename(tmp_path / x / "r.csv")
    assert len(names) == 2 and sinks.compare_folders(spark, str(tmp_path / "x"), str(tmp_path / "y")).count() == 0
    sinks.write_layer(d.withColumn("caso", F.col("k")).dropna(), str(tmp_path / "l"))
    sinks.write_layer(d.where("k = 'a'").withColumns({"caso": F.col("k"), "v": F.lit(7)}), str(tmp_path / "l"))
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "l")).collect()} == {("a", 7), ("b", 2)}
    assert sinks.backup(spark, str(tmp_path / "l"), str(tmp_path / "c")) == 2
    # files of one name in two folders are two files
    for side, text in (("p", "1"), ("q", "2")):
        for sub, t in (("a", "same"), ("b c", text)):
            (tmp_path / side / sub).mkdir(parents=True)
            (tmp_path / side / sub / "r.csv").write_text(t)
    assert {r.arquivo for r in sinks.folder_digest(spark, str(tmp_path / "p")).collect()} == {"a/r.csv", "b c/r.csv"}
    assert [r.arquivo for r in sinks.compare_folders(spark, str(tmp_path / "p"), str(tmp_path / "q")).collect()] == ["b c/r.csv"]


def test_stream_equals_batch(spark, tmp_path):
    e = table(spark, SF, "events")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{n} {t}" for n, t in e.dtypes)
    s = windows.volumes(windows.arriving(spark, str(tmp_path / "in"), schema), late="400 days")
    q = s.writeStream.outputMode("complete").format("memory").queryName("vol").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table("vol").collect())) == sorted(map(tuple, windows.volumes(e).collect()))


def test_gate_itself_opens_and_closes(spark):
    rows = [("aberto", "bloqueia", True), ("aberto", "alerta", False), ("fechado", "bloqueia", False), ("fechado", "bloqueia", True)]
    gate = qc.gate(spark.createDataFrame([(*r, layers.VERSION) for r in rows], "caso_slug string, severidade string, aprovado boolean, versao_pipeline string"))
    posts = spark.createDataFrame([(c, "1", "ana", "t") for c in ("aberto", "fechado", "sem portão")], "caso_slug string, id_nativo string, autor_handle string, texto string")
    assert [r.caso_slug for r in silver.promotable(posts, gate, layers.VERSION).collect()] == ["aberto"]
    d = "/root/testdata/sf0.001"
    want = {r.caso_slug for r in layers.c9_gate(spark, d).where("bloqueios = 0").collect()}
    assert {r.caso_slug for r in layers.QUERIES["c5_gated"](spark, d).collect()} == want
