"""Browse a lake folder the way a lake explorer does: list, discover tables, build the tree.

Usage: python examples/browse_lake.py [root] [item]
Without arguments a small lake is written to a fresh temporary folder first.
"""

import os
import sys
import tempfile
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lakeops.operators.paths import browse_item  # noqa: E402
from lakeops.session import get_session  # noqa: E402
from lakeops.sources import list_paths  # noqa: E402


def sample_lake() -> str:
    root = tempfile.mkdtemp(prefix="lake-")
    for rel in ["item/Tables/sales/_delta_log/0.json", "item/Tables/dbo/orders/_delta_log/0.json",
                "item/Files/raw/2024/a.csv", "item/Files/raw/2024/b.csv", "item/Files/notes.txt",
                "item/Files/empty/.folder_placeholder"]:
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        Path(p).write_text("x")
    return root


def main():
    root = sys.argv[1] if len(sys.argv) > 1 else sample_lake()
    item = sys.argv[2] if len(sys.argv) > 2 else "item"
    spark = get_session("local[4]")
    view = browse_item(list_paths(spark, root), item)
    view.by_schema.orderBy("schema", "name").show(truncate=False)
    view.tree.show(truncate=False)


if __name__ == "__main__":
    main()
