"""Names in quotes and nested blocks in migrations."""

from tablewarden.queries import CHANGES
from tablewarden.sources import apptext

TEXT = """class C
  def change
    add_reference "orders", "customer"
    add_belongs_to('public.events', :subject)
    add_column "nation", "region_id", :bigint
    add_reference "orders", "part", foreign_key: true
    create_table "notes" do |t|
      if x
        t.string :a
      end
      t.references :author
      t.belongs_to "editor"
    end
    create_table :others do |t|
      t.references :owner
    end
  end
end
"""


def test_quoted_names_and_nested_blocks(spark):
    files = spark.createDataFrame([("c.rb", TEXT), *CHANGES], "path string, text string")
    found = {(r["path"].split("/")[-1], r["line"], r["table_name"], r["column_name"]) for r in apptext.migration_changes(files).collect()}
    assert found == {
        ("c.rb", 3, "orders", "customer_id"), ("c.rb", 4, "public.events", "subject_id"), ("c.rb", 5, "nation", "region_id"), ("c.rb", 11, "notes", "author_id"), ("c.rb", 12, "notes", "editor_id"), ("c.rb", 15, "others", "owner_id"),
        ("1.rb", 3, "orders", "customer_id"), ("1.rb", 6, "nation", "region_id"), ("2.rb", 4, "notes", "author_id"),
    }
