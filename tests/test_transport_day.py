from isotrek.plans import catalog, reference
from tests.test_queries import DATA, duck, normal, pytestmark  # noqa: F401


def test_another_day(spark, duck):  # noqa: F811
    sql = catalog.oracle_sql()["transport_day"]
    for was, now in (("20260601", "20260328"), ("20260602", "20260329"), ("20260603", "20260330")):
        sql = sql.replace(was, now)
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    found = reference.transport_day(spark, DATA, "20260329")
    usual = reference.transport_day(spark, DATA)
    got = normal(found.columns, map(tuple, found.collect()))
    assert got == normal(columns, want.fetchall()) and got and got != normal(usual.columns, map(tuple, usual.collect()))
