"""The driver's contract, and that the library stands without the corpus operators."""

import re
import subprocess
import sys
import textwrap

import __spark_entry__ as entry
from tracewright.plans import catalog


def test_entry_gives_rows(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["record_id", "item", "n", "dates", "variants"] and rows.count() > 0


def test_every_query_of_the_catalog_gives_rows(spark):
    for name, run in catalog.queries().items():
        assert run(spark, "/root/testdata/sf0.001").limit(1).count() >= 0, name
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_the_library_stands_without_the_corpus_operators(tmp_path):
    code = """
        import sys
        for name in ("corpus_pipeline", "tracewright.llm"):
            sys.modules[name] = None
        import __spark_entry__ as entry
        assert "recurrence_events" in entry.queries() and not any(x.startswith("op") for x in entry.queries())
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=str(__import__("pathlib").Path(entry.__file__).parent))


def test_all_cards_of_all_lines_are_scanned(spark, tmp_path):
    card, odd = "4532 0151 1283 0366", "4532 0151 1283 0367"
    texts = [card, odd, f"{'7' * 25} and {card}", f"{card}, {'1' * 40}\n{odd}\n{'9-' * 30}", f"x\n{'3' * 20}", f"{'0' * 30}\nmail a@b.org {card}", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def luhn(run):
        digits = [int(c) for c in run if c.isdigit()][::-1]
        return 13 <= len(digits) <= 19 and sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(digits)) % 10 == 0

    lines = [(f"documents/{d}", n, line) for d, text in enumerate(texts) for n, line in enumerate((text or "").split("\n"), 1)]
    want = {(p, n) for p, n, line in lines if any(luhn(run) for run in re.findall(r"(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9])", line))}
    rows = entry.queries()["scan_documents"](spark, str(tmp_path)).collect()
    assert {(r.path, r.line) for r in rows if r.detector_id == "payment-card"} == want and len(want) >= 4
    assert ("email", "documents/5", 2) in {tuple(r) for r in rows}
    assert {(r.path, r.line) for r in entry.queries()["scan_luhn"](spark, str(tmp_path)).collect()} == want
