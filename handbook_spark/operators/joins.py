"""Joins of modules, extractions, handbooks and universities, and set operations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from handbook_spark.functions.dates import semester_label
from handbook_spark.functions.scoring import agreement, confidence
from handbook_spark.functions.urls import last_segment
from handbook_spark.operators.aggregates import smallest_handbook
from handbook_spark.operators.numbering import first_per_key
from handbook_spark.operators.sequences import pages_text
from handbook_spark.session import materialize

NOT_GIVEN = "k.A."
GRAM = 3
TEXT_GRAM = 6
# Up to so many grams of a key are looked for in its texts one by one: less work than taking the grams of a text.
LISTED_GRAMS = 512
# Fixed fields of a model extraction and of a regex extraction.
AI_FIELDS = (
    "module_code", "title", "ects", "lecturer", "contents", "goals", "requirements", "expense", "success_requirements",
    "exams", "module_parts",
)
MODULE_FIELDS = ("title", "ects", "content", "goals", "pages")


def join_extractions(ai: DataFrame, raw: DataFrame, modules: DataFrame, handbooks: DataFrame) -> DataFrame:
    """Model rows with their raw text, regex row and handbook.

    The equi joins are left to adaptive execution: a small handbook table is broadcast by its
    measured size and skewed codes are split.
    """
    a, r, m, h = ai.alias("ai"), raw.alias("r"), modules.alias("m"), handbooks.alias("h")
    return (
        a.join(r, F.col("ai.raw_module_id") == F.col("r.id"))
        .join(m, (F.col("r.mhb_id") == F.col("m.mhb_id")) & (F.col("r.module_code") == F.col("m.module_code")))
        .join(h, F.col("m.mhb_id") == F.col("h.id"))
        .select(
            "ai.raw_module_id",
            *[F.col(f"ai.{name}").alias(f"ai_{name}") for name in AI_FIELDS],
            "ai.weekly_hours",
            "ai.recommended_semester",
            F.col("m.id").alias("module_id"),
            F.col("m.module_code").alias("module_code"),
            *[F.col(f"m.{name}").alias(f"module_{name}") for name in MODULE_FIELDS],
            F.col("m.mhb_id").alias("mhb_id"),
            F.col("r.content").alias("raw_content"),
            F.col("h.version").alias("version"),
        )
    )


def matched_modules(modules: DataFrame, extracted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Modules with the raw row (``r``) of their handbook and code and the extracted row (``a``) of that row's id, all three from ``modules``.

    ``extracted`` keeps the rows that have an extraction. A NULL ``a`` and ``r`` stand for the module's own row. A row whose id and whose
    handbook and code occur once has no other partner than itself, so it is not shuffled; the others are joined. Partners of
    these are among these, as partners share an id or a code that repeats. Equal hashes of different codes only put rows to them.
    """
    names = modules.columns
    has_code = F.col("mhb_id").isNotNull() & F.col("module_code").isNotNull()
    code = F.when(has_code, F.xxhash64("mhb_id", "module_code"))
    keyed = modules.withColumn("_code", code)

    def repeated(key: str) -> DataFrame:
        return materialize(keyed.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > 1).select(key))

    ids, codes = repeated("id"), repeated("_code")
    alone = extracted(modules).withColumn("_code", code).filter(F.col("id").isNotNull() & F.col("_code").isNotNull())
    alone = alone.join(ids, "id", "left_anti").join(codes, "_code", "left_anti")
    others = keyed.join(ids, "id", "left_anti").join(codes, "_code", "left_semi")
    shared = materialize(keyed.join(ids, "id", "left_semi").unionByName(others).select(*names))
    row = F.struct(*names)
    a, r, m = extracted(shared).select(row.alias("a")), shared.select(row.alias("r")), shared.alias("m")
    joined = a.join(r, F.col("a.id") == F.col("r.id")).join(
        m, (F.col("r.mhb_id") == F.col("m.mhb_id")) & (F.col("r.module_code") == F.col("m.module_code")))
    own = F.lit(None).cast(a.schema["a"].dataType)
    return alone.select(*names, own.alias("a"), own.alias("r")).unionByName(joined.select(*[F.col(f"m.{n}") for n in names], "a", "r"))


def with_agreements(joined: DataFrame) -> DataFrame:
    """Search rows with the agreement of code, credits and title."""
    return joined.withColumns({
        "correct_module_code": agreement(F.col("ai_module_code"), F.col("module_code")),
        "correct_ects": agreement(F.col("ai_ects"), F.col("module_ects")),
        "correct_title": agreement(F.col("ai_title"), F.col("module_title")),
    })


def merged_modules(scored: DataFrame) -> DataFrame:
    """Both sources of a search row as one module: the regex value first, the model's where it is missing.

    The semester is given by its label; ``confidence_score`` is the mean of the agreements.
    """
    scores = [F.col(c) for c in ("correct_module_code", "correct_ects", "correct_title")]
    return scored.select(
        "raw_module_id",
        F.coalesce("module_code", "ai_module_code").alias("module_code"),
        F.coalesce("module_title", "ai_title").alias("title"),
        F.coalesce("module_ects", "ai_ects").alias("ects"),
        F.col("ai_lecturer").alias("lecturer"),
        F.col("module_content").alias("complete_content"),
        F.col("ai_contents").alias("contents"),
        F.col("module_goals").alias("complete_goals"),
        *[F.col(f"ai_{name}").alias(name) for name in ("goals", "requirements", "expense", "success_requirements")],
        "weekly_hours",
        "recommended_semester",
        F.col("ai_exams").alias("exams"),
        F.col("ai_module_parts").alias("module_parts"),
        F.col("module_pages").alias("pages"),
        F.when(F.col("version").isNotNull(), semester_label(F.col("version"))).alias("version"),
        *scores,
        F.round(confidence(*scores), 6).alias("confidence_score"),
    )


def handbook_universities(handbooks: DataFrame, universities: DataFrame) -> DataFrame:
    """Handbooks with the name and city of their university."""
    dimension = universities.select(
        F.col("id").alias("university"), F.col("name").alias("university_name"), F.col("city")
    )
    return handbooks.join(dimension, "university")


def not_yet_in(candidates: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """Candidates whose key is not known yet; a missing key never counts as known."""
    return candidates.join(known.select(*on).distinct(), list(on), "left_anti")


def content_matches(texts: DataFrame, text: str, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Look uploaded texts up by content hash: (stored rows found, hashes without a stored row)."""
    hashes = texts.select(F.md5(text).alias("content_md5")).distinct()
    found = stored.join(hashes, "content_md5", "left_semi")
    missing = hashes.join(stored.select("content_md5"), "content_md5", "left_anti")
    return found, missing


def handbook_overlap(modules: DataFrame, handbook_ids: Sequence[int]) -> DataFrame:
    """Modules of the first handbook whose code occurs in all others, pages left out.

    Attributes and order (``pos``) come from the first handbook. One scan of the chosen handbooks: the codes
    that all of them have are counted, and the first one's rows are kept by them.
    """
    ids = list(dict.fromkeys(handbook_ids))
    chosen = modules.filter(F.col("mhb_id").isin(*ids))
    return chosen.filter(F.col("mhb_id") == ids[0]).join(shared_codes(chosen, ids), "module_code", "left_semi").drop("pages")


def common_modules(modules: DataFrame, handbook_ids: Sequence[int], attributes: Sequence[str]) -> DataFrame:
    """Codes in all of the handbooks with the first one's attributes, ``k.A.`` where missing.

    Rows come in the order of the handbook with the fewest modules (the smaller id among equals). A code counts
    once per handbook; where a handbook has it several times its first row with a title is taken.
    """
    ids = list(dict.fromkeys(handbook_ids))
    chosen = modules.filter(F.col("mhb_id").isin(*ids))
    smallest = smallest_handbook(chosen).select("mhb_id").scalar()
    titled = F.when((F.col("mhb_id") == ids[0]) & F.col("title").isNotNull(), F.struct("pos", *attributes))
    codes = (
        chosen.groupBy("module_code")
        .agg(F.count_distinct("mhb_id").alias("_n"), F.min(titled).alias("_details"),
             F.min(F.when(F.col("mhb_id") == smallest, F.col("pos"))).alias("pos"))
        .filter(F.col("_n") == len(ids))
    )
    return codes.orderBy("pos").select(
        "module_code", *[F.coalesce(F.col("_details")[a].cast("string"), F.lit(NOT_GIVEN)).alias(a) for a in attributes]
    )


def compare_handbooks(modules: DataFrame, handbook_ids: Sequence[int]) -> DataFrame:
    """Overlap of different handbooks; for one and the same handbook its modules with page ranges."""
    ids = list(dict.fromkeys(handbook_ids))
    if len(ids) > 1:
        return handbook_overlap(modules, ids).orderBy("pos")
    return modules.filter(F.col("mhb_id") == ids[0]).withColumn("pages", pages_text(F.col("pages"))).orderBy("pos")


def _plain_name(name: Column) -> Column:
    return F.translate(F.lower(name), "—–", "--")


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of up to ``size`` characters."""

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.filter(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))), lambda g: F.length(g) == n)

    return F.array_distinct(reduce(lambda a, b: F.concat(a, b), [of_length(n) for n in range(1, size + 1)]))


def _grams_of_keys(outer: DataFrame, wanted: DataFrame, keys: Sequence[str], outer_id: str, outer_text: str, size: int) -> DataFrame:
    """Rows (``keys``, outer id, gram) with every gram of an outer text that ``wanted`` (``keys``, gram) has for its key, and maybe others.

    The grams wanted for a key are one list, which its texts are searched for, so no text is taken apart for grams that
    nobody looks up. A key with more than ``LISTED_GRAMS`` has no list: its texts give all their grams, so that work and
    memory for a hot key do not grow with texts times grams.
    """
    sizes = wanted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    lists = wanted.join(sizes, list(keys)).groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.collect_list(F.when(F.col("_n") <= LISTED_GRAMS, F.col("gram"))).alias("_listed"))
    text = F.col(outer_text)
    held = F.when(F.col("_n") <= LISTED_GRAMS, F.filter("_listed", lambda g: F.contains(text, g))).otherwise(_grams(text, size))
    return outer.select(*keys, outer_id, outer_text).join(lists, list(keys)).select(*keys, outer_id, F.explode(held).alias("gram"))


def containment_candidates(
    inner: DataFrame, outer: DataFrame, keys: Sequence[str], inner_text: str, outer_id: str, outer_text: str,
    size: int = GRAM,
) -> DataFrame:
    """Pairs (inner text, outer id) that may be contained in one another, per ``keys``; misses no true pair.

    Every inner text is looked up by the one of its grams that the fewest outer texts have, which
    keeps words shared by most texts out of the join. Inner texts must be distinct and not empty;
    the caller applies the substring test. With ``keys``, an outer text gives a row only for grams that the inner
    texts of its key have; see ``_grams_of_keys``.
    """
    width = F.least(F.length(inner_text), F.lit(size))
    probes = inner.select(
        *keys, inner_text, F.explode(F.filter(_grams(F.col(inner_text), size), lambda g: F.length(g) == width)).alias("gram")
    )
    on = [*keys, "gram"]
    wanted = probes.select(*on).distinct()
    if keys:
        found = _grams_of_keys(outer, wanted, keys, outer_id, outer_text, size)
    else:
        found = outer.select(outer_id, F.explode(_grams(F.col(outer_text), size)).alias("gram"))
    postings = found.join(wanted, on, "left_semi")
    sizes = postings.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    rarest = first_per_key(probes.join(sizes, on), [*keys, inner_text], [F.col("n"), F.col("gram")])
    return rarest.select(*on, inner_text).join(postings, on).select(*keys, inner_text, outer_id)


def _contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (inner, outer) of distinct names where the inner name occurs in the outer one."""
    pairs = containment_candidates(inner, outer, [], "inner", "outer", "outer")
    return pairs.filter(F.contains(F.col("outer"), F.col("inner")))


def name_matches(known: DataFrame, fetched: DataFrame) -> DataFrame:
    """Universities whose names are equal or contain one another, case and dash form ignored.

    Names are compared once per distinct name and joined back to the rows. Columns ``id``,
    ``name`` of ``known`` and ``name`` of ``fetched``.
    """
    k = known.withColumn("_known", _plain_name(F.col("name")))
    f = fetched.select(F.col("name").alias("fetched_name")).distinct().withColumn("_fetched", _plain_name(F.col("fetched_name")))
    left = k.select(F.col("_known")).where(F.col("_known") != "").distinct()
    right = f.select(F.col("_fetched")).where(F.col("_fetched") != "").distinct()
    forward = _contained(left.toDF("inner"), right.toDF("outer")).toDF("_known", "_fetched")
    backward = _contained(right.toDF("inner"), left.toDF("outer")).toDF("_fetched", "_known")
    pairs = forward.unionByName(backward).distinct()
    return k.join(pairs, "_known").join(f, "_fetched").select("id", "name", "fetched_name")


def preferred_university(known: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched data for every known university of the same name.

    The flag tells whether the fetched city is in the known comma list; a row with the flag beats
    one without it.
    """
    pairs = known.alias("k").join(fetched.alias("f"), F.col("k.name") == F.col("f.name"))
    flagged = pairs.select(
        F.col("k.id").alias("id"),
        F.col("f.website").alias("website"),
        F.col("f.hs_nr").alias("hs_nr"),
        F.array_contains(F.split(F.col("k.city"), ", "), F.col("f.city")).alias("city_check_successful"),
    )
    return first_per_key(flagged, ["id"], [F.col("city_check_successful").desc(), F.col("hs_nr")])


def _fits() -> Column:
    """The content holds every lecturer token and the credit number; a missing value always fits."""
    tokens = F.forall(F.split("lecturer", ", "), lambda token: F.contains(F.col("content"), token))
    number = F.contains(F.col("content"), F.col("ects").cast("string"))
    return F.coalesce(tokens, F.lit(True)) & F.coalesce(number, F.lit(True))


def provenance_claims(ai: DataFrame, raw: DataFrame) -> DataFrame:
    """Fitting texts of every distinct claim (code, lecturer, credits) of the model rows.

    A text fits when it has the same code and contains every lecturer token and the credit number,
    a missing value always fitting. The test depends only on claim and text, so it runs once per
    distinct pair of them: copies on either side are counted in ``copies`` and never paired.

    Each claim is looked up by the rarest gram of its longest required text, and only the texts that have
    that gram are tested. A claim without requirements is one row per code and fits every text.
    """
    texts = materialize(
        raw.filter(F.col("module_code").isNotNull()).groupBy("module_code", "content")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("raw_id"))
    )
    claims = materialize(ai.filter(F.col("module_code").isNotNull()).select("module_code", "lecturer", "ects").distinct())
    names = ["module_code", "lecturer", "ects", "raw_id", "copies"]
    required = F.filter(
        F.concat(F.coalesce(F.split("lecturer", ", "), F.array()), F.array(F.col("ects").cast("string"))),
        lambda r: r != "",
    )
    longest = F.element_at(F.array_sort(F.transform(required, lambda r: F.struct(F.length(r).alias("n"), r.alias("text")))), -1)
    probed = claims.withColumn("probe", F.when(F.size(required) > 0, longest["text"]))
    unconditional = probed.filter(F.col("probe").isNull()).join(texts, "module_code").select(*names)
    probes = probed.filter(F.col("probe").isNotNull())
    candidates = containment_candidates(
        probes.select("module_code", "probe").distinct(), texts, ["module_code"], "probe", "raw_id", "content", TEXT_GRAM
    )
    indexed = (
        candidates.join(texts, ["module_code", "raw_id"])
        .filter(F.contains(F.col("content"), F.col("probe")))
        .join(probes, ["module_code", "probe"])
        .filter(_fits())
        .select(*names)
    )
    return unconditional.unionByName(indexed)


def provenance(ai: DataFrame, raw: DataFrame) -> DataFrame:
    """Number and smallest id of the raw texts each model row can stem from."""
    matches = (
        provenance_claims(ai, raw)
        .groupBy("module_code", "lecturer", "ects")
        .agg(F.sum("copies").alias("n_matches"), F.min("raw_id").alias("first_raw_id"))
    )
    a, m = ai.alias("a"), matches.alias("m")
    same = (
        (F.col("a.module_code") == F.col("m.module_code"))
        & F.col("a.lecturer").eqNullSafe(F.col("m.lecturer"))
        & F.col("a.ects").eqNullSafe(F.col("m.ects"))
    )
    return a.join(m, same, "left").select(
        "a.raw_module_id", F.coalesce("m.n_matches", F.lit(0)).alias("n_matches"), "m.first_raw_id"
    )


def registered_domains(urls: DataFrame, suffixes: DataFrame, url: str = "url") -> DataFrame:
    """Distinct URLs with their registered ``domain``: the longest listed public suffix and one label before it.

    ``suffixes`` has one ``suffix`` per row, such as ``uk`` or ``gov.uk``. A host without a listed suffix ends with
    its last label; numeric hosts, hosts without a dot and hosts that are a suffix themselves give the URL.
    """
    host = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    hosts = urls.select(url).distinct().withColumn("_host", host).withColumn("_labels", F.split("_host", r"\."))
    count = F.size("_labels")

    def tail(n: Column) -> Column:
        return F.array_join(F.slice("_labels", count - n + 1, n), ".")

    named = F.contains(F.col("_host"), F.lit(".")) & ~F.col("_host").rlike(r"^[0-9.]+$")
    tails = hosts.filter(named).select(
        url, F.explode(F.transform(F.sequence(F.lit(1), count), lambda n: F.struct(n.alias("n"), tail(n).alias("suffix")))).alias("t")
    ).select(url, "t.n", "t.suffix")
    longest = tails.join(suffixes.select("suffix").distinct(), "suffix").groupBy(url).agg(F.max("n").alias("_n"))
    size = F.coalesce("_n", F.lit(1)) + 1
    domain = F.when(named & (count >= size), tail(size)).otherwise(F.col(url))
    return hosts.join(longest, url, "left").select(url, domain.alias("domain"))


def file_names(urls: DataFrame, lookup: DataFrame) -> DataFrame:
    """File name of every URL: looked up, else its last path segment; ``.pdf`` added when absent."""
    named = urls.join(lookup, "url", "left")
    name = F.coalesce(F.col("file_name"), last_segment(F.col("url")))
    return named.select("url", F.when(F.contains(name, F.lit(".pdf")), name).otherwise(F.concat(name, F.lit(".pdf"))).alias("file_name"))


def shared_codes(modules: DataFrame, handbook_ids: Sequence[int]) -> DataFrame:
    """Codes that occur in every one of the handbooks."""
    ids = list(dict.fromkeys(handbook_ids))
    return (
        modules.filter(F.col("mhb_id").isin(*ids))
        .select("module_code", "mhb_id")
        .distinct()
        .groupBy("module_code")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == len(ids))
        .select("module_code")
    )


def combine(parts: Sequence[DataFrame], distinct: bool = False) -> DataFrame:
    """All rows of partial results, each once when ``distinct``."""
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.distinct() if distinct else rows


def newly_found(found: DataFrame, known: DataFrame, url: str = "url") -> DataFrame:
    """Found http(s) links that are not known yet, each once."""
    return found.select(url).filter(F.col(url).startswith("http")).subtract(known.select(url))
