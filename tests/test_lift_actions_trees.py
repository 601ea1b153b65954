"""Greedy lift, follow-up actions and structured data against plain Python."""

from __future__ import annotations

import json
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from coverline.functions.components import components
from coverline.operators import compare, health
from coverline.sources import documents


def greedy(items, current):
    titles, links, raw = defaultdict(set), defaultdict(set), defaultdict(int)
    for network, candidate, title, link in items:
        raw[network, candidate] += 1
        titles[network, candidate] |= {title} - {None}
        links[network, candidate] |= {link} - {None}
    have, out = {t for t, _ in current}, {}
    new = {k: v - have for k, v in titles.items()}
    for network in {n for n, _ in raw}:
        rest = [k for k in raw if k[0] == network]
        if network == compare.NO_NETWORK or len(rest) < 2:
            out |= {k: (len(new[k]), 0, None) for k in rest}
            continue
        seen, place = set(), 0
        while rest:
            best = min(rest, key=lambda k: (-len(new[k] - seen), -len(new[k]), -raw[k], k[1]))
            place += 1
            gain = len(new[best] - seen)
            out[best] = (gain, len(new[best]) - gain, place)
            seen |= new[best]
            rest.remove(best)
    return out, {k: (raw[k], len(titles[k]), len(titles[k] & have), len(links[k])) for k in raw}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lift_is_that_of_the_greedy_order(spark, seed):
    rng = random.Random(seed)
    items = []
    for c in range(40):
        network = rng.choice(["north", "south", "independent"])
        for _ in range(rng.randrange(1, 25)):
            t = rng.randrange(30 if network == "north" else 300)
            items.append((network, f"c{c:02}", None if rng.random() < 0.05 else f"t{t}", f"l{rng.randrange(100)}"))
    items += [("alone", "c90", "t1", "l1"), ("north", "c91", None, None)]
    current = [(f"t{k}", f"l{k}") for k in range(0, 30, 4)]
    got = compare.candidate_lift(spark.createDataFrame(items, "network string, candidate string, title string, link string"), spark.createDataFrame(current, "title string, link string")).collect()
    lifts, totals = greedy(items, current)
    assert {(r.network, r.candidate): (r.lift, r.penalty, r.place) for r in got} == lifts
    assert {(r.network, r.candidate): (r.n_items, r.n_titles, r.title_overlap, r.n_links) for r in got} == totals


@pytest.mark.parametrize("most", [0, 40, 10_000])
def test_lift_of_classes_of_any_size(spark, most):
    """Classes ordered by a task, by rounds, and by rounds until they are small."""
    rng = random.Random(most)
    items = [(f"n{c % 3}", f"{rng.choice('aAé')}{c:02}", f"t{c % 2}-{rng.randrange(60)}", "l") for c in range(60) for _ in range(rng.randrange(1, 15))]
    lifts, _ = greedy(items, [])
    counted = {}
    for n, c, t, _ in items:
        counted.setdefault((n, c), []).append(t)
    rows = [(n, c, t, len(set(ts)), len(ts)) for (n, c), ts in counted.items() for t in set(ts)]
    got = compare._settled_lifts(spark.createDataFrame(rows, "network string, candidate string, title string, new_titles long, n_items long"), most).collect()
    assert len(got) == len({(r.network, r.candidate) for r in got})
    assert {(r.network, r.candidate): r.lift for r in got} == {k: lift for k, (lift, _, _) in lifts.items() if lift}


def test_a_dense_network_takes_no_round_a_candidate(spark, monkeypatch):
    """Sixty candidates that all share titles, each of which would be a round."""
    kept = []
    plain = compare.keep
    monkeypatch.setattr(compare, "keep", lambda df, name: (kept.append(name), plain(df, name))[1])
    items = spark.range(60).select(F.lit("n").alias("network"), F.format_string("c%05d", "id").alias("candidate"), F.explode(F.sequence(F.lit(0), F.col("id")).cast("array<string>")).alias("title"), F.lit("l").alias("link"))
    current = items.select("title", "link").limit(0)
    assert [r.lift for r in compare.candidate_lift(items, current).orderBy("place").collect()] == [60, *[0] * 59]
    assert len(kept) <= 6
    kept.clear()
    assert compare.candidate_totals(items, current).agg(F.sum("new_titles")).first()[0] == 60 * 61 // 2 and not kept


def test_many_candidates_take_few_rounds(spark, monkeypatch):
    """Ten thousand candidates whose titles overlap with their neighbours' only."""
    rounds = []
    plain = compare.keep
    monkeypatch.setattr(compare, "keep", lambda df, name: (rounds.append(name), plain(df, name))[1])
    k = F.col("id")
    items = spark.range(10_000).select(F.lit("n").alias("network"), F.format_string("c%05d", k).alias("candidate"), F.explode(F.sequence(k * 3, k * 3 + 2 + k % 3)).alias("t")).select("network", "candidate", F.concat(F.lit("t"), "t").alias("title"), F.lit("l").alias("link"))
    got = compare.candidate_lift(items, items.select("title", "link").limit(0))
    assert got.count() == 10_000 and got.agg(F.sum("lift")).first()[0] == items.select("title").distinct().count()
    assert rounds.count("chosen") <= 12


def test_titles_of_the_same_candidates_are_one_row(spark, monkeypatch):
    """Twelve candidates share 6,000 titles in 66 pairs; what a task orders is counted in pairs, so they take no round."""
    kept = []
    plain = compare.keep
    monkeypatch.setattr(compare, "keep", lambda df, name: (kept.append(name), plain(df, name))[1])
    pairs = [(a, b) for a in range(12) for b in range(a)]
    items = [("n", f"c{c:02}", f"t{t}", "l") for t in range(6_000) for c in pairs[t * t % 66]]
    counted = {}
    for _, c, t, _ in items:
        counted.setdefault(c, set()).add(t)
    rows = [("n", c, t, len(ts), len(ts)) for c, ts in counted.items() for t in ts]
    got = compare._settled_lifts(spark.createDataFrame(rows, "network string, candidate string, title string, new_titles long, n_items long"), 200).collect()
    lifts, _ = greedy(items, [])
    assert {("n", r.candidate): r.lift for r in got} == {k: lift for k, (lift, _, _) in lifts.items() if lift}
    assert kept.count("chosen") == 1


def test_lift_of_nothing(spark):
    none = spark.createDataFrame([], "network string, candidate string, title string, link string")
    assert compare.candidate_lift(none, none.select("title", "link")).collect() == []


def test_components_of_chains_and_clouds(spark):
    links = [(f"a{i:04}", f"a{i + 1:04}") for i in range(300)] + [("hub", f"x{i}") for i in range(50)] + [("s", "s"), (None, "q"), ("b", "c"), ("c", "b")]
    got = {r.node: r.class_id for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert {got[f"a{i:04}"] for i in range(301)} == {"a0000"} and {got[f"x{i}"] for i in range(50)} | {got["hub"]} == {"hub"} and (got["s"], got["b"], got["c"]) == ("s", "b", "b")


def test_follow_ups_take_one_action_a_class(spark):
    at = datetime(2024, 1, 1)
    backlog = spark.createDataFrame(
        [("s1", 1, "rss", "https://a.com/rss", at, "https://new.a.com/rss", "use_working_url"), ("s1", 2, "rss", "http://www.a.com/rss/", at + timedelta(1), "https://new.a.com/rss", "use_working_url"), ("s2", 3, "rss", "https://b.com/rss", at, "https://b.com/feed", "use_working_url"), ("s3", 4, "rss", "https://c.com/rss", at, None, "find_replacement"), ("s4", 5, "sitemap", "https://d.com/map", at, "https://d.com/old", "review")],
        "source string, outlet_id long, method string, url string, ran_at timestamp_ntz, works_url string, action string",
    )
    endpoints = spark.createDataFrame(
        [("X", "s1", "rss", "https://a.com/rss", True), ("X", "s1", "rss", "http://www.a.com/rss/", True), ("X", "s2", "rss", "https://b.com/rss", True), ("X", "s2b", "rss", "https://b.com/feed", True), ("X", "s3", "rss", "https://c.com/rss", False), ("X", "s4", "sitemap", "https://d.com/map", True), ("Y", "e", "sitemap", "https://e.com/map?x=1", False), ("Y", "e", "sitemap", "https://moved.com/map", True), ("Y", "f", "rss", "https://fine.com/rss", True)],
        "country string, source string, method string, url string, enabled boolean",
    )
    redirects = spark.createDataFrame([("https://E.com/map", "https://moved.com/map"), ("https://x.com/1", "https://x.com/2")], "from_url string, to_url string")
    got = {(r.country, r.method, r.class_url): (r.action, r.n_refused, r.from_url, r.to_url) for r in health.follow_ups(backlog, endpoints, redirects).collect()}
    assert got == {
        ("X", "rss", "http://www.a.com/rss/"): ("canonical_swap", 2, "http://www.a.com/rss/", "https://new.a.com/rss"), ("X", "rss", "https://b.com/feed"): ("disable_duplicate", 1, "https://b.com/rss", "https://b.com/feed"),
        ("X", "rss", "https://c.com/rss"): ("find_replacement", 1, "https://c.com/rss", None), ("X", "sitemap", "https://d.com/map"): ("find_replacement", 1, "https://d.com/map", None), ("Y", "sitemap", "https://E.com/map"): ("remove_disabled", 0, None, None),
    }
    assert health.follow_ups(backlog.limit(0), endpoints.limit(0), redirects.limit(0)).collect() == []


def page(*data, html=""):
    return html + "".join(f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>' for x in data)


def test_categories_of_structured_data(spark):
    deep = {"articleSection": "Deep"}
    for _ in range(8):
        deep = {"in": deep}
    deeper = {"in": {**deep, "articleSection": "Less deep"}}
    crumbs = lambda *names: {"@type": "BreadcrumbList", "itemListElement": [{"name": n} if k % 2 else {"item": {"name": n}} for k, n in enumerate(names)]}
    cases = {
        1: (page({"@graph": [{"@type": "NewsArticle", "articleSection": ["World", "World", "A, B; C"]}, crumbs("Home", "One", "Two", "Page")]}), ["World", "A", "B", "C", "One", "Two"]),
        2: (page({"articleSection": 'Say "no"', "section": "café"}), ["café", 'Say "no"', "Say \\"]),
        3: (page('{"articleSection": "Broken", '), ["Broken"]), 4: (page(deep), ["Deep"]), 5: (page(deeper), ["Less deep", "Deep"]), 6: (page({"articleSection": [1, None, {"x": 2}, ["no"], "yes"]}), ["yes"]),
        7: (page(crumbs("Home", "Only")), ["Only"]), 8: (page(crumbs("Home")), []), 9: (page([], "null", "3", '"text"', ""), []), 10: (None, None), 11: ("", []), 12: (page({"keywords": "k1, k2"}, {"contentSection": "Front"}), ["Front", "k1", "k2"]),
        13: (page({"@type": ["A", "breadcrumblist"], "itemListElement": [{"name": ""}, {"name": "x"}, {"item": "no name"}, {"name": "y"}]}), ["y"]),
    }
    rows = spark.createDataFrame([(k, v[0], "x") for k, v in cases.items()], "id int, html string, other string")
    got = {r.id: r.categories for r in documents.with_categories(rows).collect()}
    # what the text of a script shows counts too, however deep it is
    assert got == {k: v[1] for k, v in cases.items()}
    assert documents.with_categories(rows.limit(0)).collect() == []
    many = page({"articleSection": [f"s{k}" for k in range(50)]})
    assert documents.with_categories(spark.createDataFrame([(many,)], "html string")).first().categories == [f"s{k}" for k in range(24)]
