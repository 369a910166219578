"""Names in texts, and what texts with indicators say."""

import pytest

from tidemark.operators import gazetteer as G, scoped as C

CATALOGUE = [
    ("kyiv", "Київ", ["м. Київ"], "special_city", None, True), ("kyiv_o", "Київська область", ["Київщина"], "oblast", "kyiv_o", True),
    ("chern_o", "Чернігівська область", ["Чернігівщина"], "oblast", "chern_o", True), ("odesa_o", "Одеська область", ["Одещина"], "oblast", "odesa_o", True),
    ("pivd_od", "Південне", [], "city", "odesa_o", False), ("pivd_kh", "Південне", [], "city", "kh_o", False), ("mena", "Мена", [], "city", "chern_o", False),
    ("ivano", "Івано-Франківськ", [], "city", "if_o", True), ("long", "Велика Нова Гута за Річкою", [], "city", "kyiv_o", False), ("guta", "Нова Гута", [], "city", "odesa_o", False),
    ("myk_city", "Миколаїв", [], "city", "myk_o", True), ("myk_lviv", "Миколаїв", [], "city", "lviv_o", False), ("hor_a", "Городок", [], "city", "lviv_o", False), ("hor_b", "Городок", [], "city", "kh_o", False),
    ("brov_r", "Броварський район", [], "raion", "kyiv_o", False), ("zaz", "Зазим'я", [], "city", "kyiv_o", False), ("bar", "Бар", [], "city", "vin_o", False),
]
SCHEMA = "location_id string, name string, aliases array<string>, type string, oblast_id string, geocoded boolean, ord int"
TEXTS = [
    ("по межі Київської та Чернігівської областей", {"kyiv_o", "chern_o"}),
    ("Київська область", {"kyiv_o"}), ("Київщина та місто Київ", {"kyiv_o", "kyiv"}), ("київська кава", {"kyiv_o"}), ("летить південним курсом", set()), ("південно-західний вітер", set()),
    ("Одещина: реактив на Південне", {"odesa_o", "pivd_od"}), ("реактив на Південне", set()), ("дайте мені", set()), ("на Мена", {"mena"}), ("біля Мени", {"mena"}),
    ("над Івано-Франківськом", {"ivano"}), ("у Великій Новій Гуті за річкою", {"long"}), ("у Новій Гуті", {"guta"}), ("Велика Нова Гута за Річкою, Нова Гута", {"long", "guta"}),
    ("Миколаїв", {"myk_city"}), ("Городок", set()), ("у Броварському районі", {"brov_r"}), ("у Броварському та Київському районах", set()), ("у Броварському", set()), ("Зазим’я Зазимʼя", {"zaz"}), ("Баришівку бачать", set()),
    ("Київської, Одеської і Чернігівської областей", {"kyiv_o", "odesa_o", "chern_o"}), ("Київської кав'ярні в області", {"kyiv_o"}), (None, set()), ("", set()), ("-- '", set()),
]


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame([(*p, i) for i, p in enumerate(CATALOGUE)], SCHEMA)


def test_names_as_people_write_them(spark, catalogue):
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "id int, text string")
    rows = G.linked_places(texts, catalogue).collect()
    got = {i: {r.location_id for r in rows if r.id == i} for i in range(len(TEXTS))}
    assert {TEXTS[i][0]: got[i] for i in got} == {t: w for t, w in TEXTS}
    spans = {(r.id, r.location_id): TEXTS[r.id][0].lower()[r.start : r.end] for r in rows}
    assert spans[11, "ivano"] == "івано-франківськом" and spans[13, "guta"] == "новій гуті" and spans[0, "kyiv_o"] == "київської"


def test_no_catalogue_and_no_texts(spark, catalogue):
    none = spark.createDataFrame([], "id int, text string")
    assert G.linked_places(none, catalogue).count() == 0
    assert G.linked_places(spark.createDataFrame([(1, "Київ")], none.schema), catalogue.limit(0)).count() == 0


def test_a_long_text_of_names_takes_time_in_proportion(spark, catalogue):
    """20,000 names in one text, a third of them of one place."""
    import time

    text = "Київ, Мена, у Великій Новій Гуті за річкою, Нова Гута, Київської та Одеської областей. " * 4000
    began = time.perf_counter()
    rows = G.linked_places(spark.createDataFrame([(1, text)], "id int, text string"), catalogue).collect()
    assert {r.location_id for r in rows} == {"kyiv", "mena", "long", "guta", "kyiv_o", "odesa_o"} and time.perf_counter() - began < 60


SAID = [
    ("Зліт Ту-95", "threat", "cruise_missile", "national", ["зліт стратегічної авіації"]),
    ("Зліт Ту-95, курс на Київ", "threat", "cruise_missile", "located", ["зліт стратегічної авіації", "повідомлений напрямок без названого типу"]),
    ("Робота ворожої ППО над Курськом", "none", None, "none", []),
    ("Робота ворожої ППО", "threat", "combined", "national", ["робота ворожої ППО"]),
    ("МіГ-31К здійснив посадку, Саваслейка", "none", None, "none", []),
    ("Пуски з акваторії Чорного моря, раніше біля Москви", "threat", "cruise_missile", "national", ["пуски з морської акваторії"]),
    ("Загроза застосування балістики", "threat", "ballistic_missile", "national", []),
    ("Відділення видає посилку, дрон у крамниці", "none", None, "none", []),
    ("Київ! Увага! Ракета!", "threat", "unknown", "located", ["ракета без уточнення типу"]),
    ("Київ: дрон у музеї", "none", None, "none", []),
    ("Київ, шахед 😂", "none", None, "none", []),
    ("Не фіксуємо шахедів над Курськом", "none", None, "none", []),
    ("Не фіксуємо шахедів, Київ", "de_escalation", None, "located", []),
    (None, "none", None, "none", []),
]


def test_scope_depends_on_the_places_of_the_message(spark, catalogue):
    rows = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SAID)], "id int, text string")
    got = {r.id: (r.intent, r.threat_type, r.scope, r.indicators) for r in C.scoped_verdicts(rows, catalogue).collect()}
    assert {SAID[i][0]: got[i] for i in got} == {s[0]: s[1:] for s in SAID}


def test_a_night_that_is_told_publishes_nothing(spark, catalogue):
    rows = spark.createDataFrame([(1, "За ніч шахеди атакували Київ"), (2, "За ніч тихо")], "id int, text string")
    got = {r.id: r for r in C.scoped_verdicts(rows, catalogue).collect()}
    assert (got[1].intent, got[1].told, got[1].places, got[1].threat_types) == ("none", "vetoed", [], ["uav"]) and got[1].indicators and got[2].told is None


def test_texts_are_never_broadcast_and_meet_names_once(spark):
    """Words are more than any estimate of their messages, so neither side of texts is a broadcast; all that follows a match
    is shuffled by message once."""
    from tidemark.operators import places as P, verdicts as V

    messages = spark.range(50).selectExpr("id", "'Миколаїв та Мена' AS text")
    many = spark.range(1000).selectExpr("concat('name', id) AS name", "concat('p', id) AS location_id", "'city' AS type")
    plan = P.place_mentions(messages, V.spellings(many))._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    places = spark.createDataFrame([(*row, i) for i, row in enumerate(CATALOGUE)], "location_id string, name string, aliases array<string>, type string, oblast_id string, geocoded boolean, ord int")
    plan = G.linked_places(messages, places, 5)._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and plan.count("BroadcastHashJoin") == 1 and plan.count("hashpartitioning(id") == 1 and "SortMergeJoin" not in plan


def test_words_that_begin_names_leave_their_text_once(spark):
    """Without names every token has its keys and ends as with_tokens has them; with names a word that nothing can cover has one
    row for each spelling, and words that go on to no name, or begin none, have none."""
    from tidemark.functions import speech as S

    texts = ["Київ, Київ! Нова Гута, нова хата; Гута\x01Гута Зазим’я Зазимʼя Зазим’я", "İ 😀 Київ", "", None, "-- '", "Гута"] * 30
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    tokens = {(r.id, i): t for r in S.with_tokens(rows).collect() for i, t in enumerate(r.tokens)}
    every = {(r.id, r.n): r for r in S.first_spans(rows, 3).collect()}
    assert set(every) == set(tokens) and all((r.keys[0], r.start, r.ends[0]) == tuple(tokens[at]) for at, r in every.items())
    assert all([(k, e) for k, e in zip(r.keys, r.ends)] == [(t.key, t.end) for t in (tokens.get((r.id, r.n + o)) for o in range(3)) if t] for r in every.values())
    firsts = {"київ": (1, 1, set()), "нова": (2, 2, {"гута"}), "гута": (1, 1, set()), "зазимя": (1, 1, set())}
    got = sorted((r.n, r.keys, r.start, r.ends) for r in S.first_spans(rows, 3, firsts, {"гута"}).collect() if r.id == 60)
    # the second Гута is in Нова Гута and may be covered
    assert got == [(0, ["київ"], 0, [4]), (2, ["нова", "гута"], 12, [16, 21]), (3, ["гута"], 17, [21]), (6, ["гута"], 34, [38]), (8, ["зазимя"], 44, [51]), (9, ["зазимя"], 52, [59])]


@pytest.mark.parametrize("longest", [None, 2])
def test_names_that_are_too_many_to_broadcast_name_the_same(spark, catalogue, monkeypatch, longest):
    from tidemark.operators import places as P

    texts = spark.createDataFrame([(i, f"{t}, Нова Гута. Городок та Мена, {t}") for i, (t, _) in enumerate(TEXTS) if t], "id int, text string")
    want = sorted(map(tuple, G.linked_places(texts, catalogue, longest, 5).collect()))
    monkeypatch.setattr(P, "MOST_BROADCAST", 0)
    merged = G.linked_places(texts, catalogue, longest)
    assert sorted(map(tuple, merged.collect())) == want and {r[1] for r in want} >= {"long", "guta", "kyiv_o", "brov_r"}
    assert "SortMergeJoin" in merged._jdf.queryExecution().executedPlan().toString()


def test_documents_are_dealt_to_more_tasks_if_they_are_more(spark, small, monkeypatch):
    """However few files they come from; the rows stay those of the SQL."""
    from tests.comparing import same
    from tidemark.plans import place_queries

    query, sql = place_queries.QUERIES["place_links"]
    monkeypatch.setattr(place_queries, "DOCUMENTS_PER_TASK", 15)
    assert query(spark, small).rdd.getNumPartitions() == 14
    same(query, sql, spark, small)
