"""Driver algorithms against hand-computed results and properties."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.plans import names, violations
from tablewright.plans.dependencies import (
    Dependency,
    candidate_keys,
    classify,
    closure,
    decompose_2nf,
    decompose_bcnf,
    foreign_keys,
    is_lossless,
    is_superkey,
    minimal_cover,
    preserved,
    project,
    synthesize_3nf,
    verdict,
)

D = lambda x, y: Dependency(tuple(x), y)


def sample():
    """Order lines with product and customer data in them, and a customer table."""
    c = violations.Column
    lines = violations.Table(
        "order_items",
        (c("order_id", "integer", True), c("product_id", "integer", True), c("quantity", "integer"), c("product_name"), c("customer_id", "integer"), c("customer_email"), c("tags", "text[]"), c("ordered_at", "timestamp")),
        (D(["order_id", "product_id"], "quantity"), D(["product_id"], "product_name"), D(["order_id"], "customer_id"), D(["customer_id"], "customer_email")),
        (("order_id", "product_id"),),
    )
    customers = violations.Table("customers", (c("customer_id", "integer", True), c("email"), c("full_name")), (D(["customer_id"], "email"), D(["customer_id"], "full_name")), (("customer_id",), ("email",)))
    return lines, customers


def test_sample_counts():
    found = [v for t in sample() for v in violations.all_violations(t)]
    assert violations.summary(found)["form"] == {"1NF": 1, "2NF": 2, "3NF": 1, "BCNF": 3}
    assert violations.highest_form(found) == "UNNORMALIZED"
    assert len(violations.steps(found, "3NF")) == 4


def test_repeating_groups():
    assert violations.numbered_groups(["id", "phone1", "phone2", "phone_3", "note1"]) == {"phone": ["phone1", "phone2", "phone_3"]}
    assert violations.repeating_patterns(["home_phone", "work_phone", "first_name", "second_name", "x"]) == {"phone": ["home_phone", "work_phone"], "name": ["first_name", "second_name"]}


def test_cover_keeps_what_is_needed():
    got = {(d.determinant, d.dependent) for d in minimal_cover([D("a", "b"), D("ab", "c")])}
    assert got == {(("a",), "b"), (("a",), "c")}
    assert {(d.determinant, d.dependent) for d in minimal_cover([D("a", "c"), D("ab", "c")])} == {(("a",), "c")}
    assert len(minimal_cover([D("a", "b"), D("a", "b")])) == 1


def test_synthesis_keeps_all_columns():
    lines, _ = sample()
    parts = [r for r, _ in synthesize_3nf(lines.names, lines.dependencies)]
    assert set().union(*parts) == set(lines.names)
    assert is_lossless(parts, lines.names, lines.dependencies) and preserved(parts, lines.dependencies)


def test_second_form():
    lines, _ = sample()
    parts = dict((k, r) for r, k in decompose_2nf(lines.names, lines.primary_key, lines.dependencies))
    assert parts[("product_id",)] == ("product_id", "product_name") and parts[("order_id",)] == ("order_id", "customer_id", "customer_email")


def test_verdict_and_classes():
    fds = classify([D("ab", "c"), D("a", "c"), D("c", "d")])
    assert [d.partial for d in fds] == [True, False, False] and [d.transitive for d in fds] == [False, False, True]
    assert verdict(list("abcd"), [])["form"] == "BCNF"
    assert verdict(list("ab"), [D("a", "b")])["form"] == "BCNF"
    assert verdict(list("abcd"), fds)["form"] == "1NF"


COLUMNS = "abcde"
fds = st.lists(st.tuples(st.sets(st.sampled_from(COLUMNS), min_size=1, max_size=2), st.sampled_from(COLUMNS)).map(lambda t: D(sorted(t[0]), t[1])), max_size=6)


@settings(max_examples=60, deadline=None)
@given(fds, st.sets(st.sampled_from(COLUMNS), min_size=1))
def test_properties(deps, some):
    c = closure(some, deps)
    assert set(some) <= c and closure(c, deps) == c
    cover = minimal_cover(deps)
    assert closure(some, cover) == c
    for k in candidate_keys(COLUMNS, deps):
        assert is_superkey(k, COLUMNS, deps) and not any(is_superkey(set(k) - {x}, COLUMNS, deps) for x in k)
    for parts in ([r for r, _ in synthesize_3nf(list(COLUMNS), deps)], decompose_bcnf(list(COLUMNS), deps)):
        assert set().union(*parts) == set(COLUMNS) and is_lossless(parts, list(COLUMNS), deps)


def test_names():
    assert names.same_noun("category", "categories") and names.same_noun("shelf", "shelves") and names.same_noun("person", "people")
    assert not names.same_noun("order", "customers")
    info = {"orders": [names.ColumnInfo("orders", "id", "int", True), names.ColumnInfo("orders", "customer_id", "int")], "customers": [names.ColumnInfo("customers", "id", "bigint", True)]}
    (c,) = names.candidates(info)
    assert (c.source.name, c.target.table, c.similarity) == ("customer_id", "customers", 0.95) and names.compatible("int", "bigint")


def test_left_sides_of_many_columns():
    """No left side is too long for a decomposition or for the test of what it keeps."""
    fds = [D("abcde", "f")]
    parts = decompose_bcnf(list("abcdefg"), fds)
    assert sorted(map(set, parts), key=sorted) == [set("abcdef"), set("abcdeg")] and is_lossless(parts, list("abcdefg"), fds)
    assert preserved([tuple("abcdef"), tuple("abcdeg")], fds) and not preserved([tuple("abcdeg"), tuple("abcf")], fds)
    # a dependency that holds in a part only by way of a column outside of it
    assert {(d.determinant, d.dependent) for d in project("acd", [D("a", "b"), D("bc", "d")])} == {(("a", "c"), "d")}
    assert not preserved([tuple("ab"), tuple("acd")], [D("a", "b"), D("bc", "d")]) and preserved([tuple("ab"), tuple("bc")], [D("a", "b"), D("b", "c"), D("a", "c")])


def test_numbers_with_and_without_underscore_meet():
    assert violations.repeating_patterns(["phone1", "phone_2", "Phone_3", "fax_1", "home_fax"]) == {"phone": ["Phone_3", "phone1", "phone_2"], "fax": ["fax_1", "home_fax"]}


def test_generated_references():
    parts = [(("o", "c", "t"), ("o",)), (("c", "n", "r"), ("c",)), (("r", "x"), ("r",)), (("c", "y"), ("c",)), (("o", "p"), ("o", "p"))]
    assert foreign_keys(parts) == [(0, ("c",), 1), (0, ("c",), 3), (1, ("r",), 2), (3, ("c",), 1), (4, ("o",), 0)]
