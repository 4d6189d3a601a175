"""``python -m loomgraph list`` and ``python -m loomgraph run NAME FOLDER [ROWS]``."""

from __future__ import annotations

import sys

from .catalog import QUERIES
from .session import session


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print("\n".join(sorted(QUERIES)))
        return 0
    if args[:1] == ["run"] and len(args) >= 3 and args[1] in QUERIES:
        spark = session(master="local[*]")
        QUERIES[args[1]](spark, args[2]).show(int(args[3]) if len(args) > 3 else 20, truncate=60)
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
