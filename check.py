"""Run registered queries against their SQL: python check.py SF [name-prefix ...]"""

import importlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakewarden.session import local_session  # noqa: E402
from tests.compare import compare, connect  # noqa: E402
import workload  # noqa: E402
from workload import registry  # noqa: E402


def main() -> int:
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    for m in workload._MODULES:
        try:
            importlib.import_module(f"workload.{m}")
        except ModuleNotFoundError as e:
            print("skip", m, e)
    spark, con, bad = local_session(8, **{"spark.ui.showConsoleProgress": "false"}), connect(sf_dir), 0
    for name, fn in registry.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in registry.ORACLE:
                problems = compare(df, con, registry.ORACLE[name])
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as e:
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(problems)
        kind = "sql" if name in registry.ORACLE else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {kind:4} {time.time() - start:6.1f}s {name}", *problems, sep="\n      " if problems else " ", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
