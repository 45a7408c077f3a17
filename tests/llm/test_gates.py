"""What is tried only on texts that pass a gate must not lie outside the gate."""

import pytest
from pyspark.sql import functions as F

from tidegraph.llm import pii, residue

SLOTS = ["«Namen einfügen»", "«adınızı giriniz»", "«Enter name»", "«نام را وارد کنید»", "%_NAME_%", "%%_NAME%%", "%NAME%", "%(name)s", "{{x}}", "{%x%}", "<%x%>", "${a}", "#{a}", "[[a]]", "<<a>>", "@@a@@", "*|A|*", "__NAME__", "XX_a_XX", "$name$", "{0}", "{name}", "[your name]", "<name>", "&lt;name&gt;"]


@pytest.mark.parametrize("slot", SLOTS)
def test_every_slot_passes_the_mark(spark, slot):
    got = spark.createDataFrame([(f"Dear {slot} come",)], "t string").select(F.col("t").rlike(residue.SLOT), F.col("t").rlike(residue._SLOT_MARK)).first()
    assert tuple(got) == (True, True)


def test_texts_with_such_a_slot_are_counted(spark):
    df = spark.createDataFrame([(f"Hallo {s} bis bald", s) for s in SLOTS[:6]], "t string, s string")
    assert {r.s: r.slots for r in residue.evidence(df, "t").collect()} == dict.fromkeys(SLOTS[:6], 1)


@pytest.mark.parametrize(
    "text, kind",
    [
        ("my passport number AB123456 is lost", "identity_number"),
        ("write to anna{at}mail{dot}com please", "email"),
        ("write to anna{at }mail{ dot }com please", "email"),
        ("they live at 12 Main,Rd and wait", "street_address"),
        ("vivo en av Libertad 12 desde ayer", "street_address"),
        ("moro na r.Augusta 12 desde ontem", "street_address"),
    ],
)
def test_no_gate_is_narrower_than_its_patterns(text, kind):
    assert kind in {k for _, _, k in pii.find(text, frozenset(), frozenset())}
