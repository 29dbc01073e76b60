import pytest

from lodestone.errors import EngineError
from lodestone.functions.values import es15_8
from lodestone.plans.dialect import parse


@pytest.mark.parametrize("text", [
    "SELECT a FROM t JOIN t", "SELECT COUNT(*) FROM t", "SELECT a FROM t WHERE a IN (SELECT a FROM t)", "SELECT a FROM t WHERE b LIKE '2'",
    "SELECT DISTINCT a FROM t", "SELECT a FROM t WHERE NOT a = 1", "SELECT a FROM t WHERE (a = 1)", "SELECT a FROM t WHERE a = b",
    "SELECT a + 1 FROM t", "SELECT a FROM t ORDER BY a, b", "SELECT a FROM t LIMIT 1 OFFSET 2", "SELECT a FROM t WHERE a != 1", "SELECT a FROM t WHERE a = .25",
    "CREATE TABLE t (a BIGINT)", "CREATE TABLE t (a CHAR(0))", "INSERT INTO t VALUES (2147483648)", "SELECT a FROM t UNION SELECT a FROM t", "", "SELECT a FROM t LIMIT -1",
    "SELECT 'x", "UPDATE t SET a = b", "DELETE FROM t LIMIT 1", "SELECT t.a FROM t",
])
def test_rejected(text):
    with pytest.raises(EngineError):
        parse(text)


def test_accepted():
    s = parse("select from, b FROM where WHERE a = 'it''s' AND b BETWEEN -1 AND +2.5e3 OR c IS NOT NULL ORDER BY d DESC LIMIT 3;")
    assert s.columns == ["from", "b"] and s.table == "where" and [len(g) for g in s.where] == [2, 1]
    assert s.where[0][0].low.value == "it's" and s.where[0][1].high.value == 2500.0 and s.descending and s.limit == 3
    assert parse("INSERT INTO t VALUES (-2147483648)").values[0][0].value == -(1 << 31)


@pytest.mark.parametrize(("x", "shown"), [(2.5, "2.50000000E+00"), (-0.001, "-1.00000000E-03"), (0.0, "0.00000000E+00"), (1e100, "1.00000000+100"), (9.999999999, "1.00000000E+01"), (123456.789, "1.23456789E+05"), (-0.0, "-0.00000000E+00"), (0.1 + 0.2, "3.00000000E-01"), (1.000000005, "1.00000001E+00")])
def test_real_form(x, shown):
    assert es15_8(x) == shown
