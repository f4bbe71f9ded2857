import datetime

import pytest
from pyspark.sql import functions as F

from cairn.catalog import Catalog, Context, Index, RecordType, Relationship, Store
from cairn.functions import ranges
from cairn.functions.predicates import compiled, field
from cairn.operators import aggregates
from cairn.plans.query import Limit, OrderBy, Where, from_clauses, matching


@pytest.fixture(scope="module")
def users(spark):
    rows = [(1, "Alma", 30, "Lima", True, ["red", "round"]), (2, "Tomo", 25, "Lima", True, ["blue", "flat"]), (3, "Wilfried", 35, "Cork", False, ["red", "flat", "north"]), (4, "Dora", None, "Cork", True, []), (5, None, 25, None, None, None)]
    df = spark.createDataFrame(rows, "user_id long, name string, age int, city string, active boolean, tags array<string>")
    kind = RecordType("users", df.schema, ("user_id",))
    return Catalog([kind], {"users": [Index("by_city", "count", ("city",)), Index("by_tag", "value", ("tags",)), Index("age_order", "permuted", ("age", "name"))]}).store(df, "users")


def ids(df):
    return sorted(r.user_id for r in df.collect())


@pytest.mark.parametrize(
    ("p", "want"),
    [
        (field("age") == 30, [1]), (field("age") != 30, [2, 3, 5]), (~(field("age") == 30), [2, 3, 4, 5]), (~(field("age") != 30), [1, 4]), (field("age") < 30, [2, 5]), (~(field("age") < 30), [1, 3, 4]),
        (field("age") >= 30, [1, 3]), (~~(field("age") > 25), [1, 3]), ((field("city") == "Lima") & (field("age") <= 25), [2]), (~((field("city") == "Lima") & (field("age") <= 25)), [1, 3, 4, 5]),
        (~((field("city") == "Lima") | (field("active") == True)), [3, 5]), (field("name").has_prefix("Al"), [1]), (~field("name").has_prefix("Al"), [2, 3, 4, 5]), (field("name").contains("o"), [2, 4]),  # noqa: E712
        (field("age").is_in([25, 35]), [2, 3, 5]), (~field("age").is_in([25, 35]), [1, 4]), (field("age").is_in([]), []), (field("tags") == "red", [1, 3]), (~(field("tags") == "red"), [2, 4, 5]),
        (field("tags") != "red", [1, 2, 3]), (field("tags").is_in(["red", "flat"]), [1, 2, 3]), (field("tags").has_prefix("no"), [3]), (lambda: ~matching(F.col("age") > 26), [2, 4, 5]), (lambda: matching(F.col("age") > 26), [1, 3]),
    ],
)
def test_two_valued_logic(users, p, want):
    assert ids(users.query().where(p() if callable(p) else p).to_df()) == want


def test_wrong_kinds_raise(users):
    for p in (field("age") == "x", field("name") > 3, field("age").has_prefix("1"), field("active") == 1, field("tags") == 1, field("name") == None):  # noqa: E711
        with pytest.raises(TypeError):
            compiled(p, users.df.schema)
    with pytest.raises(KeyError):
        compiled(field("nothing") == 1, users.df.schema)


def test_filters_reach_the_scan(spark, users, tmp_path):
    users.df.write.parquet(f"{tmp_path}/u")
    df = Store(spark.read.parquet(f"{tmp_path}/u"), users.kind).query().where(~(field("age") == 30) & field("name").has_prefix("A")).select("user_id").to_df()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(name,A)" in plan and "Or(Not(EqualTo(age,30)),IsNull(age))" in plan and "city" not in plan


def test_order_limit_and_clauses(users):
    q = users.query()
    assert [r.user_id for r in q.order_by("age").order_by("name").to_df().collect()] == [4, 5, 2, 1, 3]
    assert [r.user_id for r in q.order_by("age", "desc").limit(2).to_df().collect()] == [3, 1]
    assert q.where(field("age") > 100).first() is None and q.count() == 5 and q.limit(3).count() == 3
    assert [r.user_id for r in q.top_n(2, "age").to_df().collect()] == [3, 1]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            q.limit(bad)
    out = from_clauses(q, [Where(field("age") > 1), None], OrderBy("age", "desc"), Limit(1)).to_df().collect()
    assert [r.user_id for r in out] == [3]
    assert ids(q.where(field("age") == 25).union(q.where(field("city") == "Lima"))) == [1, 2, 5]


def test_changes(spark, users):
    new = spark.createDataFrame([(2, "Bobby", 26, "Kyoto", True, None), (9, "Zoe", 1, None, None, None), (9, "Zoe", 2, None, None, None)], users.df.schema)
    work = Context(users)
    work.save(new)
    work.delete(spark.createDataFrame([(1,), (1,)], "user_id long"))
    after = work.commit()
    assert ids(after.df) == [2, 3, 4, 5, 9] and after.get(2).name == "Bobby" and after.get(9).age == 2 and users.get(2).name == "Tomo"
    work.delete(after.df)
    work.rollback()
    assert ids(work.commit().df) == [2, 3, 4, 5, 9] and after.delete_all().df.count() == 0 and after.get(77) is None


def test_catalog_checks(users):
    with pytest.raises(KeyError):
        Catalog([users.kind], {"users": [Index("bad", "value", ("nope",))]})
    with pytest.raises(ValueError):
        Index("bad", "hash", ("age",))
    with pytest.raises(ValueError):
        Index("i", "value", ("age",)).moved("readable")
    assert Index("i", "value", ("age",)).moved("write_only").moved("readable").state == "readable"
    with pytest.raises(ValueError):
        Catalog([users.kind], {"users": [Index("old", "value", ("age",))]}, former=("old",))
    tenant = RecordType("t", users.df.schema, ("user_id",), tenant=("city",))
    with pytest.raises(ValueError):
        Catalog([tenant]).store(users.df, "t")
    assert ids(Catalog([tenant]).store(users.df, "t", {"city": "Lima"}).df) == [1, 2]


def test_aggregate_lookups(users):
    assert users.aggregate(aggregates.count(), {"city": "Nowhere"}) == 0 and users.aggregate(aggregates.sum_("age"), {"city": "Nowhere"}) == 0
    assert users.aggregate(aggregates.avg("age"), {"city": "Nowhere"}) is None and users.aggregate(aggregates.max_("age")) == 35
    with pytest.raises(LookupError):
        users.aggregate(aggregates.min_("age"), {"city": "Nowhere"})
    out = users.group_by("city").agg(aggregates.count(), aggregates.avg("age")).having(lambda df: F.col("count") > 1).to_df().collect()
    assert {(r.city, r["count"], r.avg_age) for r in out} == {("Lima", 2, 27.5), ("Cork", 2, 35.0)}


def test_ranges(spark):
    t = lambda s: datetime.datetime.fromtimestamp(s, datetime.timezone.utc)
    rows = [(1, (t(0), t(100))), (2, (t(50), t(150))), (3, (t(200), t(300))), (4, None), (5, (None, t(100)))]
    df = spark.createDataFrame(rows, "user_id long, period struct<lower:timestamp,upper:timestamp>")
    q = Store(df, RecordType("e", df.schema, ("user_id",))).query()
    assert ids(q.overlaps("period", t(75), t(125)).to_df()) == [1, 2]
    assert ids(q.overlaps("period", t(100), t(200)).to_df()) == [2] and ids(q.overlaps("period", t(100), t(200), closed=True).to_df()) == [1, 2, 3]
    assert ids(q.overlaps("period", low=t(100)).to_df()) == [2, 3] and ids(q.overlaps("period", high=t(50)).to_df()) == [1]
    assert ids(q.overlaps("period", high=t(50), inclusive=True).to_df()) == [1, 2]
    assert "LocalTableScan" in q.overlaps("period", t(9), t(3)).to_df()._jdf.queryExecution().executedPlan().toString()
    assert ranges.common_window([(1, 5), (5, 9)]) is None and ranges.common_window([(1, 5), (5, 9)], closed=True) == (5, 5)
    assert ranges.common_window([(None, 5), (2, None)]) == (2, 5)


def test_related(spark, users):
    kind = RecordType("users", users.df.schema, ("user_id",), (Relationship("posts", "posts", (("user_id", "author"),)),))
    posts = spark.createDataFrame([(1, 1), (2, 1), (3, 9)], "post long, author long")
    store = Store(users.df, kind)
    assert store.related("posts", posts).count() == 2 and store.related("posts", posts, "left_anti").count() == 4 and store.related("posts", posts, "full").count() == 7
