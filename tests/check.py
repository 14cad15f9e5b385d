"""python tests/check.py [folder] [name ...]: check queries against their SQL and time them."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from shiftlens.session import session  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    wanted = set(args[1:])
    spark = session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = oracle.connect(folder), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and not any(w == name or w.endswith("*") and name.startswith(w[:-1]) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in sqls:
                found = oracle.differences(df, sqls[name], con)
                note = "same" if not found else "DIFFERENT " + " | ".join(found)
            else:
                found, note = [], f"{df.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            found, note = ["failed"], f"FAILED {type(error).__name__}: {str(error)[:600]}"
        bad += bool(found)
        print(f"{time.time() - start:6.2f}s {name}: {note[:900]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
