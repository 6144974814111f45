"""Queries of the core: one entry for each operator, with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specsift import lexicons as L
from specsift.functions import equations as Q
from specsift.functions import requirements as R
from specsift.functions import text as T
from specsift.operators import diagrams, equations, ingest, issues, nested, overview, pages, similarity, structure
from specsift.plans import independent, oracle, synthetic
from specsift.runtime import spread, table

FLAGSHIP = "issues_report_whole"
Query = Callable[[SparkSession, str], DataFrame]


def _with_views(s: SparkSession, d: str, sql: str, tables: tuple[str, ...]) -> DataFrame:
    """A SELECT of the synthetic inputs over tables read from a folder."""
    text = sql.replace("chr(10)", "char(10)").replace("\\", "\\\\")
    args = {f"t_{t}": table(s, d, t) for t in tables}
    for t in tables:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{t_{t}}}", text)
    return s.sql(_escape(text, args), **args)


def _escape(text: str, args: dict[str, DataFrame]) -> str:
    """Braces of the text are doubled, those of the tables kept."""
    text = text.replace("{", "{{").replace("}", "}}")
    for a in args:
        text = text.replace("{{" + a + "}}", "{" + a + "}")
    return text


def queries() -> dict[str, Query]:
    t = table
    stories = lambda s, d: t(s, d, "user_stories")
    models = lambda s, d: spread(t(s, d, "requirements_models"))
    raw = lambda s, d: spread(t(s, d, "raw_pages"))
    ledger = lambda s, d: structure.model_ledger(models(s, d))
    body = lambda: R.body("raw_text")

    def story(name: str, *columns: object) -> Query:
        return lambda s, d: stories(s, d).select("story_uid", *[c() if callable(c) else c for c in columns])

    def rule(*columns: Callable) -> Query:
        return lambda s, d: structure.ledger(stories(s, d)).select("story_uid", "rule_pos", *[c() for c in columns])

    def page(column: Callable) -> Query:
        return lambda s, d: raw(s, d).select("page_id", column())

    latex = lambda s, d: _with_views(s, d, synthetic.LATEX, ("part",))
    markdown = lambda s, d: _with_views(s, d, synthetic.MARKDOWN, ("part",))
    nodes = lambda s, d: _with_views(s, d, synthetic.NODES, ("supplier",))
    flow = lambda s, d: _with_views(s, d, synthetic.FLOW_NODES, ("supplier",))
    edges = lambda s, d: _with_views(s, d, synthetic.EDGES, ("supplier",))
    cells = lambda s, d: nodes(s, d).select("*", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target")).unionByName(edges(s, d).select("diagram_id", F.lit(0).cast("bigint").alias("pos"), "id", F.lit("standard.Link").alias("type"), "source", "target"), allowMissingColumns=True)
    part = lambda sql: lambda s, d: _with_views(s, d, sql, ("part",))
    supplier = lambda sql: lambda s, d: _with_views(s, d, sql, ("supplier",))
    # blocks moved up on even pages and down on odd ones, so that both strips hold some
    moved = lambda: F.when(F.col("page_num") % 2 == 0, -40.0).otherwise(640.0)
    tall = lambda s, d: raw(s, d).withColumn("font_metadata", F.transform("font_metadata", lambda b: b.withField("y0", b["y0"] + moved()).withField("y1", b["y1"] + moved())))
    # criteria added to every fifth story, some of them alike
    more = lambda: F.concat("raw_text", F.lit("\nAcceptance Criteria:\n- The entry opens in two steps\n- The entry keeps number "), F.col("story_seq").cast("string"), F.lit("\n- A copy goes to the archive desk"))
    listed = lambda s, d: stories(s, d).withColumn("raw_text", F.when(F.col("story_uid") % 5 == 0, more()).otherwise(F.col("raw_text")))
    # vague words added to the goals, and stories without an id
    vague = lambda s, d: stories(s, d).withColumn("goal", F.concat("goal", F.when(F.col("story_uid") % 3 == 0, " quickly, as needed").when(F.col("story_uid") % 3 == 1, " in real-time etc.").otherwise("")))
    nameless = lambda s, d: stories(s, d).withColumn("raw_text", F.when(F.col("story_uid") % 6 == 0, F.concat(F.lit("The operator shall confirm record "), F.col("story_seq").cast("string"), F.lit(" before the shift ends"))).otherwise(F.col("raw_text")))
    # LaTeX added to every page
    maths = lambda: F.concat("raw_text", F.lit("\nHere $$E_"), (F.col("page_num") % 5).cast("string"), F.lit(" = m c^2$$ holds. It follows. For $x_"), (F.col("page_num") % 3).cast("string"), F.lit("$ too."))
    mathematical = lambda s, d: raw(s, d).withColumn("raw_text", maths())
    # pages of which every seventh is a tag that holds a token
    tagged = lambda s, d: raw(s, d).withColumn("raw_text", F.when(F.col("page_id") % 7 == 0, "<Faculty board> opens").otherwise(F.col("raw_text")))
    # Markdown with the markers of every third page only
    marked = lambda s, d: pages.markdown_pages(raw(s, d)).withColumn("text", F.when(F.col("page_num") % 3 == 0, F.col("text")).otherwise("a\nb"))
    lines = lambda s: s.createDataFrame([(k, "d", k, line) for k, line in enumerate(synthetic.CONFLICT_LINES)], "story_uid bigint, doc_id string, story_seq int, raw_text string")
    tried = lambda s: structure.ledger(structure.structured(lines(s)).withColumn("raw_text", F.col("body")))
    return {
        "p3_found": lambda s, d: nested.links(spread(t(s, d, "requirements_models"))),
        "p3_stories": lambda s, d: nested.stories(nested.tagged(spread(t(s, d, "requirements_models")))),
        "p3_criteria": lambda s, d: nested.criteria(nested.tagged(spread(t(s, d, "requirements_models")))),
        "p3_logic": lambda s, d: nested.logic_blocks(nested.tagged(spread(t(s, d, "requirements_models")))),
        # structuring
        "extract_id": story("id", lambda: R.extract_id(body()).alias("req_id")),
        "req_type": story("type", lambda: R.type_of(R.extract_id(body())).alias("req_type")),
        "extract_condition": story("condition", lambda: R.extract_condition(body()).alias("condition")),
        "extract_action": story("action", lambda: R.extract_action(body()).alias("action")),
        "extract_actor": story("actor", lambda: R.extract_actor(body()).alias("actor")),
        "actor_normalize": story("role", lambda: R.normalize_actor("role").alias("actor")),
        "req_confidence": story("confidence", lambda: R.confidence(body()).alias("score")),
        "req_validity": story("valid", lambda: R.is_requirement(body()).alias("valid")),
        "extract_logic": lambda s, d: structure.logic(stories(s, d)),
        "story_structuring": lambda s, d: structure.structured(stories(s, d)).select("story_uid", "id", "type", "goal", "reason"),
        "inf_ids": lambda s, d: structure.inferred_ids(structure.structured(nameless(s, d))),
        "actors_per_doc": lambda s, d: structure.actors(stories(s, d)).select("doc_id", F.array_join("actors", "|").alias("actors")),
        "req_blocks": lambda s, d: structure.blocks(t(s, d, "documents"), "doc_id", "text"),
        "ac_lines": lambda s, d: structure.criteria_lines(stories(s, d)),
        "synthetic_ac": lambda s, d: structure.synthetic_criteria(stories(s, d)),
        "ac_tree_parents": lambda s, d: structure.criteria(stories(s, d)).select("story_uid", "pos", "parent", "level", "type", "text"),
        "rule_ledger": lambda s, d: structure.ledger(stories(s, d)).select("story_uid", "rule_pos", "story_id", "condition", "action", "confidence"),
        "model_rule_ledger": lambda s, d: structure.model_ledger(models(s, d)).select(F.col("story_uid").alias("model_id"), F.col("rule_pos").alias("path"), "story_id", "condition", "action", "confidence"),
        # rules
        "core_action": rule(lambda: R.core_action("action").alias("core")),
        "polarity": rule(lambda: R.polarity("action").alias("polarity")),
        "extract_context": rule(lambda: R.context("action").alias("context")),
        "concept_groups": rule(lambda: R.concept(R.context("action")).alias("concept")),
        "primary_object": rule(lambda: R.primary_object("action").alias("object")),
        "condition_logic": rule(lambda: R.condition_logic("raw_text")["variable"].alias("variable"), lambda: R.condition_logic("raw_text")["operator"].alias("operator"), lambda: R.condition_logic("raw_text")["value"].alias("value")),
        "module_prefix": rule(lambda: R.module_of("story_id").alias("module")),
        "conflict_rule_layer": lambda s, d: issues.opposed(structure.model_ledger(models(s, d))).drop("cond_key_b"),
        "condition_overlap": lambda s, d: issues.overlapping(_with_views(s, d, synthetic.RULES, ("part",))),
        "conflict_numeric": lambda s, d: issues.numeric_contradictions(_with_views(s, d, synthetic.RULES, ("part",))),
        "conflict_bounds": lambda s, d: issues.numeric_contradictions(part(synthetic.BOUNDS)(s, d)),
        "rule_pairs": lambda s, d: issues.rule_pairs(ledger(s, d)),
        "domain_gate": lambda s, d: similarity.domain_gate(part(synthetic.GATED)(s, d)).select("k", "same_domain"),
        "pairing_policy": lambda s, d: similarity.pairing(ledger(s, d)),
        "conflicts_dedup": lambda s, d: issues.conflict_issues(issues.opposed(ledger(s, d)).select("doc_id", "cond_key", "story_a", "story_b", F.col("permits").alias("action_a"), F.col("denies").alias("action_b"), F.lit("rule").alias("source"), F.lit(0.95).alias("confidence"))),
        "conflict_lines": lambda s, d: issues.conflict_issues(similarity.conflicts(tried(s))).select("issue_id", "story_a", "story_b", "source"),
        "conflict_semantic": lambda s, d: similarity.alike_conflicts(structure.model_ledger(models(s, d))),
        # ambiguities, gaps, report
        "ambiguity_vague_terms": lambda s, d: issues.story_texts(vague(s, d)).select("story_uid", "src", F.explode(issues.vague_terms("text")).alias("x")).select("story_uid", "src", "x.term", "x.severity"),
        "ambiguity_weak_verbs": lambda s, d: issues.story_texts(stories(s, d)).select("story_uid", "src", F.explode(issues.weak_verbs("text")).alias("x")).select("story_uid", "src", "x.term"),
        "ambiguity_missing_reason": lambda s, d: issues.ambiguity_hits(stories(s, d)).where("category = 'missing_reason'").select("story_uid", "text"),
        "ambiguities_dedup": lambda s, d: issues.ambiguities(stories(s, d)),
        "ambiguity_advice": lambda s, d: issues.explained(issues.ambiguities(stories(s, d))).select("doc_id", "issue_id", "explanation", "rewrite"),
        "gap_no_testable_ac": lambda s, d: issues.gap_no_logic(stories(s, d)).select("story_uid"),
        "gap_missing_error_handling": lambda s, d: issues.gap_no_errors(listed(s, d)).select("story_uid"),
        "gap_duplicate_ac": lambda s, d: issues.gap_duplicates(listed(s, d)).select("story_uid", "pos", "owner"),
        "gaps_dedup": lambda s, d: issues.gaps(listed(s, d)),
        # their SQL counts the conflicts of the rule layer only; the whole ones count all
        "issues_report": lambda s, d: issues.report(stories(s, d), ledger(s, d), issues.opposed(ledger(s, d))),
        "documents_overview": lambda s, d: overview.documents(stories(s, d), ledger(s, d), issues.opposed(ledger(s, d))),
        "conflicts_whole": lambda s, d: similarity.conflicts(ledger(s, d)),
        "issues_report_whole": lambda s, d: issues.report(stories(s, d), ledger(s, d)),
        "documents_overview_whole": lambda s, d: overview.documents(stories(s, d), ledger(s, d)),
        "missing_actors": lambda s, d: overview.missing_actors(stories(s, d)),
        "insights_topk": lambda s, d: overview.hints(stories(s, d)),
        "srs_context": lambda s, d: overview.context(stories(s, d)),
        # pages
        "clean_page_numbers": page(lambda: T.without_lines("raw_text", *L.PAGE_NUMBER).alias("text")),
        "clean_toc": page(lambda: T.without_lines("raw_text", L.TOC).alias("text")),
        "clean_references": page(lambda: pages.without_references("raw_text").alias("text")),
        "dehyphenate": page(lambda: T.dehyphenate("raw_text").alias("text")),
        "collapse_whitespace": page(lambda: T.collapse_whitespace("raw_text").alias("text")),
        "fix_unicode": page(lambda: T.fix_unicode("raw_text").alias("text")),
        "fix_ligatures": page(lambda: T.fix_ligatures("raw_text").alias("text")),
        "count_tables": lambda s, d: t(s, d, "documents").where("text is not null").select("doc_id", T.count_tables("text").alias("tables")),
        "count_figures": lambda s, d: t(s, d, "documents").where("text is not null").select("doc_id", T.count_figures("text").alias("figures")),
        "page_cleaning": lambda s, d: pages.cleaned(raw(s, d)),
        "repeated_headers": lambda s, d: pages.repeated_headers(tall(s, d)),
        "clean_running_headers": lambda s, d: pages.running_headers(tall(s, d)),
        "cleaning_stats": lambda s, d: pages.cleaning_stats(tall(s, d)),
        "asof_page": lambda s, d: pages.pages_of_lines(marked(s, d)),
        "asof_section": lambda s, d: pages.sections(raw(s, d)),
        "html_strip": lambda s, d: markdown(s, d).select("k", T.strip_html("text").alias("text")),
        "md_symbols": lambda s, d: markdown(s, d).select("k", T.markdown_symbols("text").alias("text")),
        "md_line_filters": lambda s, d: markdown(s, d).select("k", T.markdown_lines("text").alias("text")),
        "md_rules": lambda s, d: markdown(s, d).select("k", T.markdown_rules("text").alias("text")),
        "md_math_protect": lambda s, d: latex(s, d).select("k", T.around_math(F.concat("text", F.lit(" -> $a -> b$ -> c")), T.markdown_symbols).alias("text")),
        "token_loss_audit": lambda s, d: pages.token_losses(tagged(s, d)),
        "markdown_assembly": lambda s, d: pages.markdown_pages(raw(s, d)),
        "detect_columns": lambda s, d: pages.columns(raw(s, d)),
        "page_text_assembly": lambda s, d: pages.assembled(raw(s, d)),
        "font_block_stats": lambda s, d: pages.font_stats(raw(s, d)),
        # ingest
        "ingest_dedup": lambda s, d: ingest.first_of_content(t(s, d, "documents")),
        "doc_id_slug": lambda s, d: ingest.manifest(t(s, d, "doc_manifest")).select("doc_id", T.slug("file_path").alias("slug")),
        "manifest_latest": lambda s, d: ingest.manifest(t(s, d, "doc_manifest")),
        "classify_doc_type": lambda s, d: ingest.document_types(t(s, d, "doc_manifest"), raw(s, d)),
        "detect_extraction_path": lambda s, d: ingest.extraction_paths(raw(s, d)),
        "processing_flags": lambda s, d: ingest.flags(raw(s, d)),
        "page_coverage_check": lambda s, d: ingest.coverage(t(s, d, "doc_manifest"), raw(s, d)),
        "extract_stats": lambda s, d: ingest.extract_stats(raw(s, d)),
        # equations
        "eq_prefilter": lambda s, d: equations.scored_lines(raw(s, d)).where("likely").select("page_id", "line_no"),
        "eq_score": lambda s, d: equations.scored_lines(raw(s, d)).select("page_id", "line_no", "score"),
        "eq_context": lambda s, d: equations.equations(raw(s, d)).select("page_id", "line_no", "context"),
        "eq_text": lambda s, d: equations.equations(raw(s, d)).select("page_id", "line_no", "text"),
        "eq_symbols": lambda s, d: equations.equations(raw(s, d)).select("page_id", "line_no", "normal"),
        "eq_variables": lambda s, d: equations.equations(raw(s, d)).select("page_id", "line_no", "variables"),
        "eq_preprocess": lambda s, d: equations.equations(raw(s, d)).select("page_id", "line_no", "ascii"),
        "eq_dedup": lambda s, d: equations.distinct_equations(raw(s, d)),
        "eq_ids": lambda s, d: equations.equation_ids(raw(s, d)),
        "eq_union": lambda s, d: equations.every_equation_ids(mathematical(s, d)),
        "eq_surroundings": lambda s, d: equations.surroundings(mathematical(s, d)),
        "math_stats": lambda s, d: equations.math_stats(part(synthetic.MATH_TEXTS)(s, d), "k"),
        "eq_stats": lambda s, d: equations.equation_stats(raw(s, d)),
        "eq_assemble": lambda s, d: raw(s, d).select("page_id", F.posexplode(equations.assembled("raw_text")).alias("pos", "text")),
        "eq_latex": lambda s, d: latex(s, d).select("k", F.array_join(Q.latex_parts("text"), "|").alias("parts")),
        "math_merge_blocks": lambda s, d: latex(s, d).select("k", Q.merge_blocks("text").alias("text")),
        "latex_normalize": lambda s, d: latex(s, d).select("k", Q.latex_to_text(F.regexp_extract("text", r"(?s)\$\$(.+?)\$\$", 1)).alias("text")),
        "eq_number": lambda s, d: latex(s, d).select("k", Q.number_after("text").alias("number")),
        "eq_classify": lambda s, d: t(s, d, "raw_pages").select("page_id", Q.classify("raw_text").alias("kind")),
        "math_inline_pages": lambda s, d: equations.inline_math(latex(s, d).select(F.lit(1).alias("doc"), "page", "text"), "doc").select("expr", "pages"),
        # diagrams
        "diagram_type": lambda s, d: _with_views(s, d, synthetic.REQUESTS, ("documents",)).select("doc_id", diagrams.diagram_type("request").alias("kind")),
        "diagram_parse": lambda s, d: diagrams.parsed(_with_views(s, d, synthetic.ANSWERS, ("supplier",)), "k", "text").select("k", "pos", F.get_json_object("cell", "$.id").alias("id")),
        "diagram_validate": lambda s, d: diagrams.violations(supplier(synthetic.CELLS)(s, d)),
        "diagram_parse_nested": lambda s, d: diagrams.parsed(supplier(synthetic.NESTED_ANSWERS)(s, d), "k", "text").select("k", "pos", F.get_json_object("cell", "$.id").alias("id")),
        "cell_labels": lambda s, d: supplier(synthetic.ATTRIBUTES)(s, d).select("k", diagrams.label_of("attrs").alias("label")),
        "link_valid": lambda s, d: supplier(synthetic.LINKS)(s, d).select("k", diagrams.connects("source", "target").alias("valid")),
        "diagram_split": lambda s, d: cells(s, d).groupBy("diagram_id").agg(F.count_if(diagrams.is_link("type")).alias("links"), F.count_if(~diagrams.is_link("type")).alias("shapes")),
        "shape_defaults": lambda s, d: diagrams.sized(nodes(s, d)).select("diagram_id", "id", "width", "height"),
        "shape_width": lambda s, d: diagrams.sized(nodes(s, d)).select("diagram_id", "id", diagrams.width("type", "label", "width").alias("width")),
        "link_routing": lambda s, d: diagrams.routed(nodes(s, d), edges(s, d)),
        "layout_usecase": lambda s, d: diagrams.usecase_layout(nodes(s, d), edges(s, d)),
        "layout_boundary": lambda s, d: diagrams.boundary(nodes(s, d), edges(s, d)),
        "layout_dfd": lambda s, d: diagrams.dataflow_layout(flow(s, d), edges(s, d)),
        # state, similarity
        "progress_latest": lambda s, d: overview.latest_state(t(s, d, "events")),
        "history_last_n": lambda s, d: overview.history(t(s, d, "events")),
        "text_to_pseudo_story": lambda s, d: overview.pseudo_stories(t(s, d, "documents")),
        "cosine_similarity": lambda s, d: t(s, d, "embeddings").alias("a").join(t(s, d, "embeddings").alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id").alias("vec_id"), F.round(similarity.cosine("a.embedding", "b.embedding"), 6).alias("cosine")),
        "seqmatch_ratio": lambda s, d: stories(s, d).where("goal is not null and reason is not null").select("story_uid", similarity.ratio("goal", "reason").alias("ratio")),
        "knn_indexed": lambda s, d: similarity.indexed_nearest(t(s, d, "embeddings")).select("query_id", "vec_id", "rank"),
        "knn_candidate_pairs": lambda s, d: similarity.candidate_pairs(t(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return oracle.sql() | independent.sql()
