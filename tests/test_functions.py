import datetime as dt

from pyspark.sql import functions as F

from crowdtide import fixed_values as V
from crowdtide.functions import dates as D
from crowdtide.functions import geo, scoring, similarity, text

D1 = dt.date


def L(v):
    return F.lit(v)


def S(v):
    return F.lit(v).cast("string")


def N(v):
    return F.lit(v).cast("timestamp_ntz")


def test_uk_dates(one):
    got = one(*[D.parse_uk_date(S(x)) for x in ("21/09/2026", "2026-09-21", "Sat 21 Sep 2026", "21.09.26", "not a date", "22 Sep 2026", "1st of May 2027", "May 3, 2027",
                                                "31/02/2026", None, "2026-09-21T10:00:00")])
    assert got == (D1(2026, 9, 21),) * 4 + (None, D1(2026, 9, 22), D1(2027, 5, 1), D1(2027, 5, 3), None, None, D1(2026, 9, 21))


def test_times(one):
    got = one(*[D.parse_time(S(x)) for x in ("19:30", "7.30pm", "TBC", None, "12:15 am", "25:00", "7:30PM", "doors 7pm", "19:30:00", "nothing")])
    assert got == ("19:30", "19:30", None, None, "00:15", None, "19:30", "19:00", "19:30", None)


def test_local_zone(one):
    d, t = D.split_local(N("2026-08-15 19:00:00"))
    assert one(d, t) == (D1(2026, 8, 15), "20:00")
    d, t = D.split_local(N("2026-12-15 15:00:00"))
    assert one(d, t) == (D1(2026, 12, 15), "15:00")
    d, t = D.split_local(N("2026-07-01 23:30:00"))
    assert one(d, t) == (D1(2026, 7, 2), "00:30")


def test_schema_datetimes(one):
    cases = {
        "2026-09-22T12:00": (D1(2026, 9, 22), "12:00"), "2026-07-01T19:30:00+01:00": (D1(2026, 7, 1), "19:30"), "2026-07-01T18:30:00Z": (D1(2026, 7, 1), "19:30"),
        "2026-12-01T18:30:00Z": (D1(2026, 12, 1), "18:30"), "2026-09-22 14:00:00": (D1(2026, 9, 22), "14:00"), "2026-09-22": (D1(2026, 9, 22), None), None: (None, None),
        "garbage": (None, None)}
    for value, want in cases.items():
        assert one(*D.parse_schema_datetime(S(value))) == want, value


def test_names_titles(one):
    assert one(text.normalize_name(S("Café  d'Été & Søn!"))) == "cafe dete and s n"
    assert one(text.normalize_name(S(None))) == ""
    assert one(text.normalize_title(S("The Killers - Live!"))) == "killers"
    assert one(text.clean_title(S("  a \t b\n c "))) == "a b c"
    assert one(text.slugify(S("The O2 (Arena)!"))) == "the-o2-arena"
    a = text.fingerprint(S("The Killers - Live!"), L(D1(2026, 10, 1)), S("The O2"), S("London"))
    b = text.fingerprint(S("Killers Live"), L(D1(2026, 10, 1)), S("the o2"), S("LONDON"))
    x, y = one(a, b)
    assert x == y and len(x) == 64


def test_strip_accents_any_script(spark):
    rows = spark.createDataFrame([("Ångström ﬁn",), (None,)], "s string").select(text.strip_accents_any("s").alias("s")).collect()
    assert [r.s for r in rows] == ["Angstrom fin", None]


def test_postcode_status_url(one):
    assert one(text.normalize_postcode(S("ha90ws")), text.normalize_postcode(S("ab")), text.normalize_postcode(S(None))) == ("HA9 0WS", None, None)
    got = one(*[text.normalize_status(S(x)) for x in ("https://schema.org/EventCancelled", "onsale", "postponed", None, "whatever")])
    assert got == ("CANCELLED", "SCHEDULED", "POSTPONED", "SCHEDULED", "SCHEDULED")
    assert one(text.normalize_url(S(" x.org/a ")), text.normalize_url(S("http://x.org")), text.normalize_url(S(" "))) == ("https://x.org/a", "http://x.org", None)
    assert one(text.url_depth(S("https://x.org/a/b/")), text.url_depth(S("https://x.org")), text.url_depth(S("/a?b=/c/d"))) == (2, 0, 1)
    assert one(text.merge_url(S("https://x.org/e/"), S("https://x.org/e/a")), text.merge_url(S("https://x.org/e/a/b"), S("https://x.org/e/a"))) == (
        "https://x.org/e/a", "https://x.org/e/a/b")


def test_url_problems(one):
    bad = ["http://127.0.0.1/x", "http://localhost:8000/", "http://169.254.169.254/latest", "file:///etc/passwd", "ftp://example.com/", "http://10.0.0.5/",
           "http://[::1]/", "http://u:p@example.com/", "http://db.internal/", None]
    got = one(*[text.url_problem(S(u)) for u in bad])
    assert got == ("private_ip", "host", "private_ip", "scheme", "scheme", "private_ip", "private_ip", "credentials", "host", "scheme")
    allow = ["venue.example"]
    assert one(text.url_problem(S("https://www.venue.example/x"), allow), text.url_problem(S("https://evil.example/x"), allow)) == (None, "not_in_allowlist")
    assert one(text.url_problem(S("https://8.8.8.8/x"))) is None


def test_classifier(one):
    def cls(title, hint=None, desc=None):
        r = one(text.classify(S(title), S(hint), S(desc)))
        return r.category, r.subcategory, r.confidence

    assert cls("Coldplay Live at Wembley")[:2] == ("music", "concert")
    assert cls("Arsenal v Chelsea", "football Premier League") == ("sports", "football", 1.0)
    assert cls("Freshers Week 2026")[:2] == ("education", "university")
    assert cls("Manchester Food Festival")[:2] == ("festival", "food")
    assert cls("Random thing") == ("other", "general", 0.3)
    assert cls("Liverpool v Everton", "fallback:concert")[:2] == ("sports", "football")
    assert cls("Some Untitled Thing", "fallback:concert") == ("music", "concert", 0.5)
    assert cls("Some Untitled Thing", None, "a chamber orchestra") == ("music", "concert", 0.6)
    assert cls("Cheltenham Festival Day 1")[1] == "horse_racing"
    assert cls("Stand-up: Live Comedy Night")[0] == "comedy"
    assert cls("Graduation Ceremony 2026")[0] == "education"
    assert cls("Hamilton the Musical")[0] == "theatre"


def test_merge_hint(one):
    assert one(text.merge_hint(S("MusicEvent"), S("fallback:community"))) == "MusicEvent fallback:community"
    assert one(text.merge_hint(S("Event"), S("fallback:x"))) == "fallback:x"
    assert one(text.merge_hint(S("Event"), S(None))) is None


def test_similarity_thresholds(spark):
    rows = [("Liverpool v Bournemouth", "Liverpool vs AFC Bournemouth", "Anfield", "Anfield", "Liverpool", "Liverpool", True),
            ("Liverpool v Bournemouth", "Everton v Arsenal", "Anfield", "Goodison Park", "Liverpool", "Liverpool", True),
            ("A", "A", None, None, None, None, False),
            ("Arsenal v Chelsea", "Arsenal vs Chelsea", "Emirates Stadium", "Emirates", "London", "London", True),
            ("Arsenal v Chelsea", "Coldplay Live", "Emirates Stadium", "Wembley", "London", "London", True)]
    df = spark.createDataFrame(rows, "ta string, tb string, va string, vb string, ca string, cb string, same boolean").coalesce(1)
    got = [r.s for r in df.select(similarity.duplicate_confidence(*[F.col(c) for c in df.columns]).alias("s")).collect()]
    assert got[0] >= V.MERGE_THRESHOLD and got[1] < 0.7 and got[2] == 0.0 and got[3] >= 0.8 and got[4] < 0.6
    said = [similarity.ratio(F.lit("abcd"), F.lit("abxd")), similarity.token_set_ratio(F.lit("a b c"), F.lit("c b")), similarity.token_set_ratio(F.lit(""), F.lit("a"))]
    assert tuple(df.limit(1).select(*said).first()) == (75.0, 100.0, 0.0)


def test_sessions(one):
    got = one(D.different_session(S("10:30"), S("12:00"), 1), D.different_session(S("10:30"), S("12:00")), D.different_session(S("11:00"), S("14:00")),
              D.different_session(S(None), S("14:00")), D.different_session(S("14:00"), S("14:00")))
    assert got == (True, False, True, False, False)


def test_freshness_and_silence(one):
    now = N("2026-09-18 12:00:00")
    got = one(*[D.freshness_score(N(x), now) for x in ("2026-09-18 12:00:00", "2026-09-11 12:00:00", "2026-07-20 12:00:00", None)])
    assert got == (100, 55, 10, 10)
    s = one(D.source_silent(N("2026-09-16 12:00:00"), L(D1(2026, 10, 1)), now), D.source_silent(N("2026-08-19 12:00:00"), L(D1(2026, 10, 1)), now),
            D.source_silent(N("2026-08-19 12:00:00"), L(D1(2026, 9, 1)), now))
    assert s == (False, True, False)


def test_distance_and_match(one):
    assert abs(one(geo.haversine_km(L(53.79), L(-1.55), L(53.79), L(-1.55)))) < 1e-6
    near, far = one(geo.match_confidence(L(0.2), L(10), L(180), 2.0), geo.match_confidence(L(1.9), L(170), L(180), 2.0))
    assert 0 <= far < near <= 1


def test_booking_timestamps(one):
    got = one(*[D.parse_booking_timestamp(S(x)) for x in ("2026-09-10T18:30:00", "2026-09-10 18:30", "10/09/2026 18:30", "10/09/2026", "NULL", "", None, "junk", "10 Sep 2026 6:05pm")])
    assert got == (dt.datetime(2026, 9, 10, 18, 30),) * 3 + (dt.datetime(2026, 9, 10), None, None, None, None, dt.datetime(2026, 9, 10, 18, 5))


VENUE = dict(v_name="Big", v_capacity=60000, v_importance=1.0, v_seeded=True, v_station_km=2.5, v_airport_km=13.0)
CITY = dict(c_name="London", c_priority=100, c_tourism=1.0, in_area=True)
SCHEMA = ("category string, date_start date, date_end date, time_start string, time_end string, status string, v_name string, v_capacity int, v_importance double, "
          "v_seeded boolean, v_station_km double, v_airport_km double, c_name string, c_priority int, c_tourism double, in_area boolean")


def score(spark, **kw):
    base = dict(category="music", date_start=D1(2026, 10, 3), date_end=None, time_start="19:30", time_end=None, status="SCHEDULED", **VENUE, **CITY)
    base.update(kw)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return scoring.score_events(spark.createDataFrame([tuple(base[n] for n in names)], SCHEMA)).first()


def test_demand_score(spark):
    assert sum(V.SCORE_WEIGHTS.values()) == 100
    r = score(spark)
    assert r.demand_level == "VERY_HIGH" and 0 <= r.opportunity_score <= 100
    assert any("Major venue" in x for x in r.reasons) and "Weekend" in r.reasons
    big = score(spark, category="sports", time_start="15:00")
    small = score(spark, category="sports", time_start="15:00", v_capacity=800, c_priority=40, c_tourism=0.1)
    assert big.opportunity_score > small.opportunity_score + 20
    assert score(spark, status="CANCELLED").opportunity_score == 0
    # 20*1 + 20*1 + 15*1 + 15*1 + 10*.95 + 10*1 + 5*1 + 5*.375 -> 1.9
    assert r.components.asDict() == {"event_scale": 20.0, "venue_scale": 20.0, "timing": 15.0, "location": 15.0, "transport": 9.5, "category": 10.0, "tourism": 5.0, "duration": 1.9}


def test_windows(one):
    w = one(scoring.demand_windows(S("music"), L(D1(2026, 10, 3)), S("19:00"), S("22:00")))
    assert (w.label, w.pre_start, w.pre_end, w.post_start, w.post_end, w.peak) == ("Modelled demand window", "16:00", "19:00", "22:00", "00:30", "22:20")
    assert one(scoring.demand_windows(S("music"), L(D1(2026, 10, 3)), S(None), S(None))).available is False


QUALITY = ("source_confidence string, time_start string, venue_id bigint, venue_name_raw string, city_id bigint, official_url string, ticket_url string, postcode string, "
           "latitude double, category string, subcategory string, source_count int, freshness_score int, school_confidence string")


def test_quality(spark):
    rows = [("OFFICIAL", "19:00", 1, "x", 1, "https://x", None, "A", 1.0, "music", None, 2, 100, None),
            ("UNVERIFIED", None, None, None, None, None, None, None, None, "other", None, 1, 10, None),
            ("OFFICIAL", "09:00", None, "x", 1, None, None, None, None, "education", "school", 1, 100, "LOW")]
    hi, lo, school = scoring.score_quality(spark.createDataFrame(rows, QUALITY).coalesce(1)).collect()
    assert hi.quality_level == "HIGH" and hi.event_quality_score == 100 and any("OFFICIAL" in r for r in hi.quality_reasons)
    assert lo.quality_level == "LOW" and any(r.startswith("Stale") for r in lo.quality_reasons)
    assert any("(-20)" in r for r in school.quality_reasons)


def test_status_engine(one):
    def st(current="SCHEDULED", incoming="SCHEDULED", title="Show", sold=False, n=1, day=D1(2027, 1, 1), moved=False):
        return one(scoring.derive_status(S(current), S(incoming), S("OFFICIAL"), S(title), L(sold), L(n), L(day), L(moved), L(D1(2026, 9, 18)))).status

    assert st(title="Show (CANCELLED)") == "CANCELLED"
    assert st(incoming="POSTPONED") == "POSTPONED"
    assert st(moved=True) == "RESCHEDULED"
    assert st(sold=True) == "SOLD_OUT"
    assert st(n=2) == "CONFIRMED"
    assert st(current="CONFIRMED") == "CONFIRMED"
    assert st(current="CANCELLED") == "CANCELLED"
    assert st(day=D1(2026, 1, 1)) == "COMPLETED"
    assert st(incoming="CONFIRMED") == "CONFIRMED"


def test_confidence_merge(one):
    assert one(scoring.better_confidence(S("CURATED"), S("TRUSTED")), scoring.better_confidence(S("SECONDARY"), S("OFFICIAL")),
               scoring.better_confidence(S(None), S(None)), scoring.better_confidence(S(None), S("TRUSTED"))) == ("CURATED", "OFFICIAL", "UNVERIFIED", "TRUSTED")


def test_compatibility_letters(spark):
    import unicodedata

    cells = ["ﬁnal Ⅳ ½ Ångström", "Café ①", "Straße ™ №5", "ﷺ", "plain", None] + ["".join(chr(c) for c in range(a, a + 64)) for a in range(0x80, 0xD7C0, 64) if not 0xABC0 < a < 0xD7A4]
    want = [None if x is None else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)) for x in cells]
    df = spark.createDataFrame(list(enumerate(cells)), "k int, s string")
    got = [r.s for r in df.select("k", text.strip_accents("s").alias("s")).orderBy("k").collect()]
    assert got[:6] == want[:6]
    assert [g for g, w in zip(got, want) if g != w and sorted(g) != sorted(w)] == []
    names = [r.n for r in df.where("k < 2").select("k", text.normalize_name("s").alias("n")).orderBy("k").collect()]
    assert names == ["final iv 1 2 angstrom", "cafe 1"]


def test_jsonld_depth(spark):
    from crowdtide.sources.html import jsonld_events, page_profile

    inner = '{"@type":"MusicEvent","name":"deep","startDate":"2026-10-01"}'
    pages = [
        (1, f'<script type="application/ld+json">{{"@graph":[{{"@type":"ItemList","itemListElement":[{{"@type":"ListItem","item":{inner}}}]}}]}}</script>'),
        (2, '<script type="application/ld+json">[[{"@type":["Thing","http://schema.org/Festival"],"name":"a\tb"}]]</script>'),
        (3, '<script type="application/ld+json">{"@type":"Event", broken</script>'),
        (4, "BEGIN:VCALENDAR\nBEGIN:VEVENT\nEND:VEVENT\nBEGIN:VEVENT\nEND:VEVENT\nEND:VCALENDAR"),
        (5, "<?xml version='1.0'?>\n<!-- " + "x" * 900 + " -->\n<rss><channel><item></item><item></item></channel></rss>"),
        (6, "<link rel='alternate' type='application/rss+xml' href='/feed'>"), (7, "<p>nothing</p>"), (8, None)]
    chain = "".join('{"@type":"Event","name":"%d","startDate":"2026-10-01","subEvent":[' % k for k in range(40)) + "]}" * 40
    pages.append((9, f'<script type="application/ld+json">{{"mainEntity":{chain}}}</script>'))
    df = spark.createDataFrame(pages, "page_id int, html string")
    deep = jsonld_events(df.where("page_id = 9")).select(F.get_json_object("item", "$.name").alias("n")).collect()
    assert sorted(int(r["n"]) for r in deep) == list(range(40))
    assert page_profile(df.where("page_id = 9")).first().n_items == 40
    got = {r.page_id: r["n"] for r in jsonld_events(df.where("page_id < 9")).groupBy("page_id").agg(F.collect_list(F.get_json_object("item", "$.name")).alias("n")).collect()}
    assert got == {1: ["deep"], 2: ["a\tb"]}
    kinds = {r.page_id: (r.kind, r.n_items) for r in page_profile(df).collect()}
    assert kinds[1] == ("JSONLD", 1) and kinds[2] == ("HTML_ONLY", 0) and kinds[4] == ("ICS", 2) and kinds[5] == ("RSS", 2) and kinds[6] == ("HAS_FEED_LINK", 0) and kinds[7] == ("HTML_ONLY", 0)


def test_dates_without_year_and_offsets(spark, one):
    from crowdtide.functions.dates import parse_uk_date
    from crowdtide.sources.payloads import ticketing

    day = F.lit("2026-09-18").cast("date")
    got = one(*[parse_uk_date(F.lit(x), day).cast("string") for x in ("21 September", "Sat 3rd Oct", "21/09/2025", "soon")], parse_uk_date(F.lit("21 September")).cast("string"))
    assert got == ("2026-09-21", "2026-10-03", "2025-09-21", None, None)
    page = '{"_embedded":{"events":[{"id":"a","name":"n","dates":{"start":{"dateTime":"%s"}}}]}}'
    rows = ticketing(spark.createDataFrame([(page % "2026-07-01T23:30:00+01:00",), (page % "2026-07-01T23:30:00Z",)], "value string")).select("date_start").collect()
    assert sorted(str(r.date_start) for r in rows) == ["2026-07-01", "2026-07-02"]
