"""Decisions of a search that depend on sizes and signals: expansion of tokens, candidate policy, order of providers."""

from __future__ import annotations

import unicodedata
from math import ceil

from pyspark.sql import Column, functions as F

from quernstone.functions.stem import stem_token
from quernstone.operators.chunking import segment_word

CJK_GRAMS = 256  # n-grams of one token without spaces


def expand(token: str, words: frozenset[str], case_sensitive: bool = False) -> list[str]:
    """A query token as the tokens to look for: itself if it is short, known or case matters; else the words it is made of."""
    t = unicodedata.normalize("NFKD", token)
    t = t if case_sensitive else t.lower()
    if case_sensitive or len(t) <= 3 or t in words:
        return [t]
    return segment_word(t, words)


def stems(tokens: list[str], stemming: bool | str, language: str | None = None) -> list[str]:
    """Tokens by their English stems, where stemming is on, or automatic and the language is said to be English."""
    if stemming is True or (stemming == "auto" and language == "en"):
        return [stem_token(t) for t in tokens]
    return list(tokens)


def cjk_tokens(text: str) -> list[str]:
    """A run of characters without spaces as itself and its n-grams of two and three, the first CJK_GRAMS."""
    run = text.strip()
    grams = [run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1)]
    return list(dict.fromkeys([run, *grams]))[: CJK_GRAMS + 1] if run else []


def decide(rules: list[tuple[Column, tuple]], default: tuple, names: list[str]) -> Column:
    """struct(names) of the first rule whose condition holds: a decision table as one expression, for any number of rows."""
    value = lambda row: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for v, n in zip(row, names)])
    out = value(default)
    for condition, row in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), value(row)).otherwise(out)
    return out


def query_signals(tokens: Column) -> Column:
    """struct(tokens, characters, variety, symbols) of a list of query tokens: distinct tokens a token, and characters that are no letter, digit or underscore a character."""
    n, characters = F.size(tokens), F.aggregate(tokens, F.lit(0), lambda s, t: s + F.length(t))
    odd = F.aggregate(tokens, F.lit(0), lambda s, t: s + F.length(F.regexp_replace(t, "[0-9A-Za-z_]", "")))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return F.struct(n.alias("tokens"), characters.alias("characters"), share(F.size(F.array_distinct(tokens)), n).alias("variety"), share(odd, characters).alias("symbols"))


# When a query is simple, varied or short, and how many rows beyond the first ones are then reranked: at least, and by share of those asked for.
RERANK = {
    "simple_tokens": 2, "simple_symbols": 0.25, "varied_tokens": 7, "varied_share": 0.9, "varied_symbols": 0.35, "short_tokens": 3, "short_symbols": 0.3,
    "clear_gap": 0.2, "clear_hits": 8, "clear_factor": 2, "weak_hits": 3, "weak_share": 0.8, "dense_factor": 2, "most": 200,
}
RERANK_ROWS = {"high_confidence_low_entropy": (4, 0.25), "high_entropy_or_low_confidence": (None, 0.9), "moderate_confidence_short_query": (6, 0.35)}


def rerank_budget(signals: Column, hits: Column, first: Column, second: Column, dense_hits: Column, top_n: int = 10, slack: int = 8) -> Column:
    """struct(slack, cap, reason): rows to rerank beyond top_n. Fewer for simple queries whose first hit leads clearly, more for varied ones and weak hits."""
    t = RERANK
    leads = (first > 0) & (second >= 0) & ((first - second) / first >= t["clear_gap"]) & (hits >= max(t["clear_factor"] * top_n, t["clear_hits"]))
    simple = (signals["tokens"] <= t["simple_tokens"]) & (signals["symbols"] < t["simple_symbols"])
    varied = (signals["tokens"] >= t["varied_tokens"]) | (signals["variety"] >= t["varied_share"]) | (signals["symbols"] >= t["varied_symbols"])
    weak = (hits < max(t["weak_hits"], ceil(t["weak_share"] * top_n))) | (dense_hits >= t["dense_factor"] * top_n)
    short = (signals["tokens"] <= t["short_tokens"]) & (signals["symbols"] < t["short_symbols"])
    when = {"high_confidence_low_entropy": leads & simple, "high_entropy_or_low_confidence": varied | weak, "moderate_confidence_short_query": short}

    def row(reason):
        least, share = RERANK_ROWS[reason]
        n = min(t["most"], max(slack if least is None else least, ceil(share * top_n)))
        return n, top_n + n, reason

    least = min(t["most"], max(0, slack))
    return decide([(when[r], row(r)) for r in RERANK_ROWS], (least, top_n + least, "baseline"), ["slack", "cap", "reason"])


# Bounds of a candidate set, and reasons, of the dense search.
CANDIDATES_LEAST, CANDIDATES_MOST = 100, 20_000


def candidate_policy(candidates: Column, allowed: Column, filters_active: Column, least: int = CANDIDATES_LEAST, most: int = CANDIDATES_MOST) -> Column:
    """struct(among, reason): what a dense search looks among: the candidates of the sparse side, the allowed ids, nothing, or all.

    candidates: how many there are after the allowed ids are applied; allowed: how many ids filters allow, null without such a list. Too few candidates
    are no bound, and too many only under filters, where hits from outside must not crowd out the others.
    """
    filtered = F.coalesce(filters_active, F.lit(False))
    listed = filtered & (F.coalesce(allowed, F.lit(0)) > 0)
    none = F.coalesce(candidates, F.lit(0)) == 0
    return decide([
        (none & listed, ("allowed", "filtersActiveAllowedIdx")), (none & filtered & allowed.isNotNull(), ("nothing", "noCandidates")), (none, ("all", "noCandidates")),
        ((candidates > max(least, most)) & filtered, ("candidates", "tooLarge")), (candidates > max(least, most), ("all", "tooLarge")),
        ((candidates < least) & listed, ("allowed", "filtersActiveAllowedIdx")), (candidates < least, ("all", "tooSmallNoFilters")),
    ], ("candidates", "ok"), ["among", "reason"])


# Bounds of routing, and orders of providers by what a search is like.
ROUTE = {"small_index": 64, "few_candidates": 16, "query_candidates": 64, "short_tokens": 2, "short_characters": 18, "symbol_heavy": 0.3}
ORDERS = {
    "symbolHeavyQuery": "hnsw sqlite-vector lancedb dense", "largeIndex": "hnsw lancedb sqlite-vector dense",
    "smallCandidateSet": "dense sqlite-vector hnsw lancedb", "proseHeavyMode": "lancedb hnsw sqlite-vector dense",
}
ORDER_BOUNDS = {"documents": 50_000, "candidates": 10_000, "few": (16, 128)}


def route(signals: Column, documents: Column, candidates: Column, filters_active: Column, providers: Column) -> Column:
    """struct(route, reason): whether a search goes to vectors or stays sparse: sparse for tiny indexes, few candidates and short queries of symbols."""
    r = ROUTE
    short = (signals["tokens"] > 0) & (signals["tokens"] <= r["short_tokens"]) & (signals["characters"] <= r["short_characters"])
    some = candidates > 0
    return decide([
        (filters_active, ("vector", "filtersActive")), (providers <= 0, ("vector", "noProviders")), ((documents > 0) & (documents <= r["small_index"]), ("sparse", "smallIndexBypass")),
        (some & (candidates <= r["few_candidates"]), ("sparse", "lowCandidateBypass")),
        (some & (candidates <= r["query_candidates"]) & short & (signals["symbols"] >= r["symbol_heavy"]), ("sparse", "queryClassBypass")),
    ], ("vector", "routeVector"), ["route", "reason"])


def provider_order(signals: Column, mode: Column, documents: Column, candidates: Column, available: list[str]) -> Column:
    """struct(providers, reason): available providers in the order in which a search tries them; those that an order does not name keep theirs, last."""
    few = ORDER_BOUNDS["few"]
    ordered = lambda reason: F.array(*[F.lit(p) for p in [*[p for p in ORDERS[reason].split() if p in available], *[p for p in available if p not in ORDERS[reason].split()]]])
    when = {
        "symbolHeavyQuery": signals["symbols"] >= ROUTE["symbol_heavy"], "largeIndex": (documents >= ORDER_BOUNDS["documents"]) | (candidates >= ORDER_BOUNDS["candidates"]),
        "smallCandidateSet": (candidates >= few[0]) & (candidates <= few[1]), "proseHeavyMode": mode.isin("prose", "extracted-prose"),
    }
    return decide([(when[r], (ordered(r), r)) for r in ORDERS], (F.array(*[F.lit(p) for p in available]), "unchanged"), ["providers", "reason"])


MINHASH_LIMIT = 5_000  # candidates up to which signatures are compared where vectors find nothing


def fallback_source(vector_hits: Column, retry_hits: Column, candidates: Column, allowed: Column, limit: int = MINHASH_LIMIT) -> Column:
    """Where the hits of a dense stage come from: vectors, vectors among the allowed ids, signatures of candidates, of allowed ids, or nowhere."""
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    return (
        F.when(some(vector_hits), "vector").when(some(allowed) & some(retry_hits), "vector_allowed").when(some(candidates) & (candidates <= limit), "minhash")
        .when(some(allowed) & (allowed <= limit), "minhash_allowed").otherwise("none"))


def branch_allows(wanted: str | None, actual: Column) -> Column:
    """Whether a repository on a branch answers a query that names one."""
    return F.lit(True) if not wanted else F.coalesce(actual == wanted, F.lit(False))
