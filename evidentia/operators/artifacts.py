"""Proposals in words: what an artifact looks like, what has to be confirmed, who reviews it, how it is verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL = "A draft for review, not a finished change"
#: A blank form for each type; brackets hold what the owner has to supply.
FORMS = {
    "title": "<title>[what the page is about] - [whose page it is]</title>",
    "meta-description": '<meta name="description" content="[one or two true sentences on what the page offers]">',
    "canonical": '<link rel="canonical" href="[the preferred public URL]">',
    "heading-structure": "<h1>[topic of the page]</h1>\n<h2>[topic of a section]</h2>\n<p>[checked text]</p>",
    "visible-faq-and-jsonld": '<h2>Questions</h2>\n<h3>[a question that visitors ask]</h3>\n<p>[its checked answer]</p>\n<script type="application/ld+json">{"@context": "https://schema.org", "@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "[the same question]", "acceptedAnswer": {"@type": "Answer", "text": "[the same answer]"}}]}</script>',
    "structured-data": '<script type="application/ld+json">{"@context": "https://schema.org", "@type": "[a type that fits what is visible]", "name": "[the visible name]"}</script>',
    "provider-or-reviewer-block": "<aside><h2>Who wrote and checked this</h2><p>[name, role, qualification that can be verified, date of the review]</p></aside>",
    "references-and-risk-section": '<section><h2>Limits, risks and sources</h2><p>[checked limits and alternatives]</p><a href="[source]">[what it supports]</a></section>',
    "trust-or-contact-block": "<section><h2>Contact</h2><address>[current name, address, telephone, area served]</address></section>",
    "internal-links": '<nav><a href="[a related page]">[what is found there]</a></nav>',
    "page-brief": "Brief for {rule}\nSeen: {difference}\nNeed to look into: [question]\nClaims to confirm: [claims]\nSections: [outline]\nSources: [sources]",
    "comparison-table": "<table><caption>[what is compared]</caption><tr><th>Option</th><th>[property]</th></tr><tr><td>[option]</td><td>[checked value]</td></tr></table>",
    "image-alt-guidance": "An image that informs: say in its alt text what it tells. An image that decorates: alt=\"\", after a check with a screen reader.",
}
COMMON_FACT = "Each name, place, person, date and claim in the draft is true and current."
FACTS = {
    "canonical": "The preferred URL, its redirects and its duplicates are known.", "provider-or-reviewer-block": "Identity, role, qualification, licence and date of review can be shown.",
    "visible-faq-and-jsonld": "Visitors ask the questions, and markup and visible answers are the same.", "structured-data": "The visible page supports each type and property.", "trust-or-contact-block": "Address, telephone, area and responsible body are current.",
}
REVIEW = {"professional": "Facts, wording, law and a qualified professional; medical claims a clinician.", "editorial": "Facts and wording; law and accessibility where the page calls for it."}
ASSUMED = ("The cited evidence still holds when the change is made.", "The part serves a real purpose of the page.")
CHECKS = ("Compare the rendered page and its source with the draft.", "Run the comparison again and look for the rule.")


def _pick(key: Column, values: dict[str, str], other: str | None = None) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], F.lit(other).cast("string"))


def difference(target: Column, benchmark: Column, missing: Column) -> Column:
    """What differs, in numbers or in values."""
    plain = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    return F.when(missing.isNotNull(), F.concat(F.lit("only competitors have: "), F.array_join(missing, ", "))).otherwise(F.concat(F.lit("the target has "), plain(target), F.lit(", the benchmark "), plain(benchmark)))


def written(proposals: DataFrame, gaps: DataFrame) -> DataFrame:
    """``proposals`` (``compare.proposals``) with ``label, draft, assumptions, facts_to_confirm, review_requirement, verification_steps``; ``gaps`` are
    the conclusions they were made of. A gap that is gone leaves the difference in a brief open."""
    said = gaps.where("kind = 'gap'").select("run_id", "rule_id", difference(F.col("target"), F.col("benchmark"), F.col("missing") if "missing" in gaps.columns else F.lit(None).cast("array<string>")).alias("difference"))
    rows = proposals.join(said, ["run_id", "rule_id"], "left")
    form = F.replace(F.replace(_pick(F.col("artifact_type"), FORMS), F.lit("{rule}"), F.col("rule_id")), F.lit("{difference}"), F.coalesce("difference", F.lit("[difference]")))
    facts = F.array_compact(F.array(F.lit(COMMON_FACT), _pick(F.col("artifact_type"), FACTS)))
    return rows.withColumns({
        "label": F.lit(LABEL), "draft": form, "assumptions": F.array(*map(F.lit, ASSUMED)), "facts_to_confirm": facts, "review_requirement": _pick(F.col("review"), REVIEW), "verification_steps": F.array(*map(F.lit, CHECKS)),
    })
