"""Calls without a receiver, without brackets and with nested arguments."""

from tablewarden.sources import apptext

OWN = """class Order
  scope :mine, -> { where(o_custkey: 1).order(:o_orderdate) }
  def where(x) = 1
  def self.late
    where o_custkey: [1, 2], o_total: 3 if x
    Order.
      where(o_total: 1)
  end
end
"""
OTHER = """where(o_custkey: 1)
Order.where o_custkey: 1
Order.where(o_total: f(g(1))).order(:o_orderdate)
order = 5
"""


def test_calls_in_every_form(spark):
    files = spark.createDataFrame([("app/models/order.rb", OWN), ("lib/b.rb", OTHER)], "path string, text string")
    models = spark.createDataFrame([(1, "Order", "orders", "app/models/order.rb")], "seq long, model string, table_name string, source_location string")
    known = spark.createDataFrame([("orders", c) for c in ("o_custkey", "o_orderdate", "o_total")], "table_name string, column_name string")
    found = apptext.source_usages(files, models, known).orderBy("seq").collect()
    assert [(r["path"][-8:], r["line"], r["operation"], r["column_name"], r["where_columns"]) for r in found] == [
        ("order.rb", 2, "order", "o_orderdate", ["o_custkey"]), ("order.rb", 2, "where", "o_custkey", []), ("order.rb", 5, "where", "o_custkey", []), ("order.rb", 5, "where", "o_total", []), ("order.rb", 6, "where", "o_total", []),
        ("lib/b.rb", 2, "where", "o_custkey", []), ("lib/b.rb", 3, "order", "o_orderdate", ["o_total"]), ("lib/b.rb", 3, "where", "o_total", []),
    ]
    assert found[1]["source"] == "where(o_custkey: 1).order(:o_orderdate)"
