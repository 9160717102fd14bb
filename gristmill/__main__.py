"""Command line: ``stats DIRECTORY`` reports on a page log, ``replay DIRECTORY`` lists its bans, ``crawl DIRECTORY``
crawls through a cache server into a directory, or on from where it stands."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from gristmill import conf
from gristmill.operators import stats, traps
from gristmill.plans import driver
from gristmill.runtime import local_session
from gristmill.sources import pagelog


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gristmill", description=__doc__)
    parser.add_argument("command", choices=["stats", "replay", "crawl"])
    parser.add_argument("directory", nargs="?", default="text")
    parser.add_argument("--stop-words", help="a file with one stop word a line")
    parser.add_argument("--output", default="crawler_stats.txt")
    parser.add_argument("--config_file", default="config.ini", help="settings of a crawl")
    parser.add_argument("--restart", action="store_true", help="drop what an earlier crawl left in the directory")
    parser.add_argument("--rounds", type=int, help="stop after so many rounds")
    parser.add_argument("--scope", help="domain that links must lie in, below one of the units")
    args = parser.parse_args(argv)
    if args.command == "crawl":
        config = conf.CrawlConfig.read(args.config_file)
        scope = conf.Scope(domain=args.scope) if args.scope else conf.Scope()
        state = driver.run(local_session("*"), config, args.directory, args.restart, args.rounds, scope)
        print(state.where("completed").count(), "fetched,", state.where("not completed").count(), "left")
        return 0
    if not Path(args.directory).exists():
        print(f"no directory at {args.directory}", file=sys.stderr)
        return 1
    spark = local_session("*")
    log = pagelog.read(spark, args.directory)
    if args.command == "replay":
        for ban in traps.pattern_bans(pagelog.replay(log)).orderBy("host", "pattern").toLocalIterator():
            print(ban.host, ban.pattern, ban.seq, ban.reason)
        return 0
    words = stats.stop_word_lines(open(args.stop_words, encoding="utf-8")) if args.stop_words else []
    report = stats.report(stats.first_pages(log), spark.createDataFrame([(w,) for w in words], "word string"))
    print(report, end="")
    stats.write_report(report, args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
