"""Text functions, parsers and folds on small invented cases."""

from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillframe.functions import parsers
from quillframe.functions import text as tx
from quillframe.operators import citations, planning, reports, state


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"])
    return row.select(column.alias("r")).first().r


def plain_slug(text, most):
    t = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    t = re.sub(r"[^A-Za-z0-9]+", "-", t).strip("-")
    if len(t) > most:
        t = t[:most]
        t = t[: t.rfind("-")] if t.rfind("-") > 0 else t
    return t.strip("-") or "DOCUMENT"


@pytest.mark.parametrize("text", ["Étude de sol n° 12", "___", "a" * 70, "one-two three four five six seven eight nine ten eleven twelve", "çà et là", "x"])
def test_slug(spark, text):
    assert one(spark, tx.slug(F.col("t"), 20), t=text) == plain_slug(text, 20)


def test_file_names(spark):
    name = tx.normalized_filename(F.lit("DCE/ADMIN"), F.col("lot"), F.lit("Règlement"), F.col("n"))
    assert one(spark, name, lot="1, 2", n="Mon fichier.été.PDF") == "DCE_LOT1-2_REGLEMENT_MON-FICHIER-ETE.pdf"
    assert one(spark, name, lot="", n="plan") == "DCE_REGLEMENT_PLAN"
    assert one(spark, tx.extension(F.col("n")), n=".ds_store") == ""


@pytest.mark.parametrize(("text", "lot"), [("Lot-3 gros oeuvre", "3"), ("lot n°3", None), ("LOT 1, 2 et 4", "1, 2 et 4"), ("lots de travaux", None), ("", None), ("lot 5 - 6", "5 - 6")])
def test_lot_signal(spark, text, lot):
    assert one(spark, tx.lot_signal(F.col("t")), t=text) == lot


def test_terms_need_word_boundaries(spark):
    assert one(spark, tx.holds_term(tx.fold_terms(F.col("t")), F.lit("TRC")), t="un TRC, oui") is True
    assert one(spark, tx.holds_term(tx.fold_terms(F.col("t")), F.lit("trc")), t="élecTRCique") is False
    assert one(spark, tx.holds_term(tx.fold_terms(F.col("t")), F.lit("")), t="x") is False


def test_first_line_and_items(spark):
    assert one(spark, tx.first_line(F.col("t")), t="\n<!-- page -->\n## - Title *x\nrest") == "Title *x"
    assert one(spark, tx.first_line(F.col("t")), t=" \n ") is None
    assert one(spark, tx.clean_item(F.col("t")), t=" - 12) point") == "12) point"


def test_key_mentions(spark):
    patterns = {"bay": r"\bbay\s*#?\s*(\d+)\b", "form": r"\bform\b", "none": r"\bzebra\b", "drink": "th[ée]"}
    found = one(spark, tx.key_mentions(F.col("t"), patterns), t="The FORM of bay # 3 and of BAY 12, du thé")
    assert found["bay"] == ["12", "3"] and found["form"] == ["form"] and "thé" in found["drink"] and "none" not in found


@pytest.mark.parametrize("text", ["Ångström ŁÓDŹ ő ű", "ﬁn ½ ﬄ Ĳ", "e\u0301te\u0301", "naïve…", "ﬀ² ª º", "plain"])
def test_folding_is_compatibility_decomposition(spark, text):
    expected = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    assert one(spark, tx.fold_accents(F.col("t")), t=text) == expected


def test_field_query(spark):
    row = spark.createDataFrame([("Owner", "a name", [r"\bown(er)?\b", r"own\s(er)", r"\d"]), ("Date", "", None)], "l string, e string, p array<string>")
    found = [r.q for r in row.select(tx.field_query(F.col("l"), F.col("e"), F.col("p")).alias("q")).collect()]
    assert found == ["Owner — a name — Termes associés : own er", "Date"]


def packed(text: str, most: int) -> list[str]:
    """Paragraphs packed the plain way: first cut, then filled up."""
    pieces = []
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        cuts = [p[i : i + most] for i in range(0, len(p), most)]
        pieces += [(c, i < len(cuts) - 1) for i, c in enumerate(cuts)]
    groups: list[list[str]] = []
    open_group = False
    for part, whole in pieces:
        room = most - sum(len(x) + 2 for x in groups[-1]) if open_group else 0
        if whole or not open_group or len(part) > room:
            groups.append([])
        groups[-1].append(part)
        open_group = not whole
    return ["\n\n".join(g) for g in groups]


@pytest.mark.parametrize("text", ["", " \n ", "a", "aa\n\nbb\n \ncc", "x" * 25 + "\n\nyy", "12345\n\n12345\n\n123", "x" * 20, "ab\n\n" + "z" * 10 + "\n\ncd"])
@pytest.mark.parametrize("most", [1, 5, 10])
def test_chunks(spark, text, most):
    assert one(spark, parsers.chunks(F.col("t"), most), t=text) == packed(text, most)


@pytest.mark.parametrize(("text", "shown"), [
    ("x ⟦cite:c1⟧⟦cite:c2⟧ y\n⟦cite:c1⟧", "x  (A, B) y\nA"), ("| ⟦cite:c1⟧ |", "| A |"), ("⟦cite:c9⟧said", "said"), ("said ⟦cite:c1⟧ ⟦cite:c2⟧", "said  (A)  (B)"),
    ("x⟦cite:c1⟧⟦cite:c2⟧⟦cite:c3⟧⟦cite:c4⟧⟦cite:c5⟧", "x (A, B, C et 2 autres)"), ("none", "none"), ("", ""),
])
def test_marks_as_files(spark, text, shown):
    names = F.create_map(*(F.lit(x) for i, f in enumerate("ABCDE", 1) for x in (f"c{i}", f)))
    assert one(spark, parsers.marks_as_files(F.col("t"), names), t=text) == shown


def test_certainty_and_quarantine(spark):
    assert one(spark, tx.answer_certainty(F.lit(0.9), F.lit(None).cast("double"))) == "certain"
    assert one(spark, tx.answer_certainty(F.lit(0.9), F.lit(0.5))) == "probable"
    assert one(spark, tx.answer_certainty(F.lit(0.4), F.lit(0.9))) == "to_verify"
    assert [one(spark, tx.quarantine_seconds(F.lit(s), F.lit(n))) for s, n in ((401, 2), (429, 20), (500, 2), (500, 3))] == [600, 300, 0, 180]
    assert one(spark, tx.clamp(F.lit(95.0))) == 1.0


def test_label_groups(spark):
    keys = F.create_map(F.lit("D1"), F.lit("c1"), F.lit("D1.2"), F.lit("c2"))
    text = "a [D1.2][D7] b (D1, D9) c (D8) [D1; D1.2]"
    assert one(spark, citations.resolved(F.col("t"), keys), t=text) == "a ⟦cite:c2⟧ b ⟦cite:c1⟧ c (D8) ⟦cite:c1⟧⟦cite:c2⟧"
    assert one(spark, tx.strip_labels(F.col("t")), t="x [D1] y (D2, D3)") == "x y"


def test_fragments_and_prefix_match(spark):
    cite = "Résumé « le mur porteur est fissuré sur toute sa hauteur » [...] une autre partie assez longue"
    found = one(spark, tx.fragments(F.col("t")), t=cite)
    assert found[0] == "le mur porteur est fissure sur toute sa hauteur" and "une autre partie assez longue" in found
    page = "xx le mur porteur est fissure sur toute sa longueur"
    hit = one(spark, tx.found_at(F.col("p"), F.col("f")), p=page, f=found[0])
    assert (hit.position, hit.length) == (4, 40)


def greedy(parts, budget):
    order = sorted(range(len(parts)), key=lambda i: -parts[i][0])
    left, taken = budget, set()
    for i in order:
        if not taken:
            taken.add(i)
        elif left <= 0:
            break
        elif len(parts[i][1]) > left:
            continue
        else:
            taken.add(i)
        left -= len(parts[i][1])
    return "\n\n".join(parts[i][1] for i in sorted(taken))[:budget]


@pytest.mark.parametrize("parts", [[(1, "aaa"), (5, "b" * 30), (2, "cc")], [(3, "x" * 10), (3, "y" * 5), (3, "z" * 4), (0, "w")], [(0, "q")]])
def test_packed_excerpt(spark, parts):
    rows = F.array(*(F.struct(F.lit(s).alias("score"), F.lit(i).alias("pos"), F.lit(p).alias("part")) for i, (s, p) in enumerate(parts)))
    assert one(spark, planning.packed_excerpt(rows, 20)) == greedy(parts, 20)


def test_budgets_and_batches(spark):
    assert one(spark, planning.spent_budget(F.array(F.lit(50), F.lit(70), F.lit(90)), 100, 60)) == [50, 50, 0]
    assert one(spark, planning.sequential_batches(F.array(*map(F.lit, [30, 40, 40, 10, 100, 1])), 3, 100)) == [0, 0, 1, 1, 2, 3]


def test_distinct_targets(spark):
    names = ["a.pdf", "a.pdf", "a-2.pdf", "a.pdf", "b", "b"]
    rows = spark.createDataFrame([("f", n, i) for i, n in enumerate(names)], "folder string, name string, i int")
    found = [r.target for r in reports.distinct_targets(rows, "folder", "name", "i").orderBy("i").collect()]
    assert found == ["a.pdf", "a-3.pdf", "a-2.pdf", "a-4.pdf", "b", "b-2"] and len(set(found)) == 6


def test_status_order(spark):
    assert one(spark, state.at_or_after(F.lit("classified"), F.lit("uploaded"))) is True
    assert one(spark, state.at_or_after(F.lit("error"), F.lit("uploaded"))) is False
