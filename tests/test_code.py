"""Token rows, and usages through variables, scopes and helpers."""

from tablewarden.sources import code, tokens
from tablewarden.workspace import ranked

MODELS = [(1, "Shop::Payment", "payments", "app/models/payment.rb"), (2, "User", "users", None)]
KNOWN = [(i, t, c, k) for t in ("payments", "users") for i, (c, k) in enumerate([("id", "int"), ("user_id", "int"), ("status", "int"), ("created_at", "timestamp"), ("meta", "jsonb")])]


def usages(spark, *files):
    found = code.analysed(
        spark.createDataFrame(list(files), "path string, text string"), spark.createDataFrame(MODELS, "seq long, model string, table_name string, source_location string"),
        spark.createDataFrame(KNOWN, "seq int, table_name string, column_name string, sql_type string"),
    )
    rows = found.orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(1, len(rows) + 1))
    return [(r["path"].split("/")[-1], r["line"], r["operation"], r["column_name"], ",".join(r["where_columns"])) for r in rows]


TEXT = '''class A < B # it's "one"
=begin
where(a: 1)
=end
  x = <<~SQL.squish + 'it\\'s' if y / 2 > 1 / z
    it's # no comment
  SQL
  a = %w[if end #] and puts "b #{c["d"]} \\" #" =~ /e#'f/i
  def g!(h: 1) = i&.j(:k?, "l": @m)
end
'''


def test_tokens_are_the_whole_file(spark):
    files = spark.createDataFrame([("a.rb", TEXT), ("b.rb", "'open"), ("c.rb", ""), ("d.rb", "x = <<~EOS\nnever ends")], "path string, text string")
    rows = tokens.lexed(files).orderBy("path", "i").collect()
    for path, text in (("a.rb", TEXT), ("b.rb", "'open"), ("d.rb", "x = <<~EOS\nnever ends")):
        own = [r for r in rows if r["path"] == path]
        assert "".join(r["text"] for r in own) == text
        assert all(r["pos"] == sum(len(x["text"]) for x in own[:i]) and r["line"] == text[: r["pos"]].count("\n") + 1 for i, r in enumerate(own))
    kinds = [(r["kind"], r["text"]) for r in rows if r["path"] == "a.rb" and r["kind"] not in ("space", "newline", "mark", "name", "constant", "number")]
    assert kinds == [
        ("keyword", "class"), ("comment", "# it's \"one\""), ("comment", "=begin\nwhere(a: 1)\n=end"), ("heredoc_start", "<<~SQL"), ("string", "'it\\'s'"), ("keyword", "if"), ("heredoc", "\n    it's # no comment\n  SQL"),
        ("words", "%w[if end #]"), ("keyword", "and"), ("string", '"b #{c["d"]} \\" #"'), ("pattern", "/e#'f/i"), ("endless", "def g!(h: 1) ="), ("symbol", ":k?"), ("string", '"l"'), ("variable", "@m"), ("keyword", "end"),
    ]


MODEL = '''class Shop::Payment < Base
  scope :paid, -> { where(status: :paid) }
  scope(:late) { where(created_at: 1) }
  scope :mine, ->(who) { paid.where(user_id: who).order(:id) }
  def self.delegated
    find_by_status(:paid)
  end
  def self.find_by_status(status)
    where(status: status)
  end
  class << self
    def single; where user_id: 2; end
    def circle = round.where(id: 4)
    def round = circle
  end
  def instance = where(id: 9)
  def self.odd(x)
    where(id: 1) if x
  end
  scope :late, -> { where(id: 5) }
end
'''


CALLS = {
    "paid": "status", "late": "id", "mine(1)": "status,user_id", "delegated": "status", "single": "user_id", "circle": "id", "round": "id", "instance": "", "odd(1)": "", "paid.joins(:x).single": "status,user_id",
    "where(id: 1).paid.where('meta @> ?', 1)": "id,status", "unscoped": "",
}


def test_scopes_and_helpers(spark):
    """Definitions in a file later in order are not known in one before."""
    text = "".join(f"Shop::Payment.{call}.order(created_at: :desc)\n" for call in CALLS)
    got = usages(spark, ("app/models/payment.rb", MODEL), ("lib/a.rb", text), ("app/controllers/b.rb", "Shop::Payment.paid.order(:id)"))
    assert got[0] == ("b.rb", 1, "order", "id", "")
    assert [(line, filters) for path, line, operation, _, filters in got if path == "a.rb" and operation == "order"] == list(enumerate(CALLS.values(), 1))


LOCALS = '''class Report
  def call(given)
    rel = Shop::Payment.where(status: 1)
    rel.order(:id)
    rel = rel.where(user_id: 2).order(:status).where(id: 1)
    [1].each do |x|
      rel.reorder "created_at DESC, id"
      rel = User.where(id: x)
      rel.order(:status)
    end
    given.map { |rel| rel.order(:id) }
    rel.order(:created_at)
    pick = rel || User
    pick.order(:id)
    f = ->(rel) { rel.order(:id) }
    given.where(id: 1)
  end
  def other
    rel.order(:id)
  end
end
'''


def test_local_variables(spark):
    assert usages(spark, ("lib/a.rb", LOCALS)) == [
        ("a.rb", 3, "where", "status", ""), ("a.rb", 4, "order", "id", "status"),
        ("a.rb", 5, "where", "id", ""), ("a.rb", 5, "order", "status", "status,user_id,id"), ("a.rb", 5, "where", "user_id", ""),
        ("a.rb", 7, "order", "created_at", "status,user_id,id"), ("a.rb", 7, "order", "id", "status,user_id,id"),
        ("a.rb", 8, "where", "id", ""), ("a.rb", 9, "order", "status", "id"), ("a.rb", 12, "order", "created_at", "status,user_id,id"),
    ]


def test_ranks_over_many_parts(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as n", "id").repartition(13)
    assert [r["n"] for r in ranked(df, "n").orderBy("n").collect()] == list(range(1, 1001))
    assert ranked(df.limit(0), "n").count() == 0


def test_no_files(spark):
    assert usages(spark) == [] and usages(spark, ("a.rb", ""), ("b.rb", "x = 1")) == []


def test_parts_follow_the_text(spark, monkeypatch):
    """As many parts as the text makes, also where its compressed rows would fit one; the results and the session's settings stay."""
    monkeypatch.setattr(tokens, "PART_CHARS", 100)
    files = spark.createDataFrame([(f"lib/{i}.rb", "x = 1\n" * 20) for i in range(10)], "path string, text string")
    assert tokens.parts_of(files) == 13 and tokens.lexed(files).rdd.getNumPartitions() == 13
    before = {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql.")}
    got = usages(spark, ("lib/a.rb", LOCALS), ("lib/b.rb", "User.where(id: 1).order(:status)\n"))
    assert len(got) == 12 and got[-1] == ("b.rb", 1, "where", "id", "")
    assert {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql.")} == before


def test_tokens_are_computed_once(spark):
    """Files are cut once, no frame adds up the rest of a file for each token, and windows share their sorts."""
    rows = code.linked(spark.createDataFrame([("lib/a.rb", LOCALS)], "path string, text string"), 2)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode(regexp_extract_all") == 1 and "RowFrame, 1, unboundedfollowing" not in plan
    assert plan.count("Sort [") <= 9


STRAY = ''') end ]
rel = User.where(id: 1)
def a(rel)
  rel.order(:id)
end end }
rel.order :status
foo.each do |rel, x| rel.order(:id); end
bar(rel.order(:user_id), User.where(status: [1, (2)]).order "id"
'''


def test_closers_without_an_opener(spark):
    assert usages(spark, ("lib/a.rb", STRAY)) == [
        ("a.rb", 2, "where", "id", ""), ("a.rb", 6, "order", "status", "id"), ("a.rb", 8, "order", "user_id", "id"), ("a.rb", 8, "order", "id", "status"), ("a.rb", 8, "where", "status", ""),
    ]
