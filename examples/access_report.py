"""Which access roles open which parts of a lake listing, from landed role pages.

Usage: python examples/access_report.py
Writes a small lake and two landed JSON pages of role definitions to a fresh temporary
folder, then: read pages -> rows -> typed roles -> roles per path -> per-role counts.
"""

import json
import os
import sys
import tempfile
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from lakeops.operators.access import ROLE_SCHEMA, role_path_counts, roles_for_path  # noqa: E402
from lakeops.operators.nested import load_page_dumps  # noqa: E402
from lakeops.session import get_session  # noqa: E402
from lakeops.sources import list_paths, read_page_dumps  # noqa: E402


def setup() -> tuple[str, str]:
    base = tempfile.mkdtemp(prefix="access-")
    lake = os.path.join(base, "lake")
    for rel in ["Tables/Sales/part-0.parquet", "Tables/SalesOld/part-0.parquet", "Files/hr/people.csv"]:
        p = os.path.join(lake, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        Path(p).write_text("x")
    pages = os.path.join(base, "pages")
    os.makedirs(pages)
    rule = lambda *paths: {"effect": "Permit", "permission": [
        {"attributeName": "Path", "attributeValueIncludedIn": list(paths)},
        {"attributeName": "Action", "attributeValueIncludedIn": ["Read"]}]}
    page1 = {"value": [{"id": "r1", "name": "Sales", "decisionRules": [rule("Tables/Sales")],
                        "members": {"microsoftEntraMembers": [{"tenantId": "t", "objectId": "ann",
                                                               "objectType": "User"}]}}],
             "continuationToken": "next"}
    page2 = [{"id": "r2", "name": "Everything", "decisionRules": [rule("*")], "members": {}}]
    Path(pages, "p1.json").write_text(json.dumps(page1))
    Path(pages, "p2.json").write_text(json.dumps(page2))
    return lake, pages


def main():
    lake, pages = setup()
    spark = get_session("local[4]")
    items = load_page_dumps(read_page_dumps(spark, pages))
    roles = items.select(F.from_json(F.to_json("item"), ROLE_SCHEMA).alias("r")).select("r.*")
    listing = list_paths(spark, lake).where(~F.col("isDirectory")).select(F.col("name").alias("path"))
    roles_for_path(listing, roles).orderBy("role_id", "path").show(truncate=False)
    # a list_paths listing never repeats a path, so the counts can skip de-duplication
    role_path_counts(listing, roles, distinct_paths=False).orderBy("role_id").show()


if __name__ == "__main__":
    main()
