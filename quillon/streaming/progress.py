"""What streams say of their own progress."""

from __future__ import annotations

import json
from collections import OrderedDict

from pyspark.sql.streaming import StreamingQueryListener

#: Runs of streams that are remembered.
RUNS = 100


class Progress(StreamingQueryListener):
    """The last batch of each run: its number, rows, seconds, rows a second, and where its source ended;
    and rows and batches of the run so far. Nothing is counted again for it."""

    def __init__(self):
        self.runs: OrderedDict[str, dict] = OrderedDict()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        before = self.runs.pop(p["runId"], {"batches": 0, "all_rows": 0})
        rows = p.get("numInputRows", 0)
        source = (p.get("sources") or [{}])[0]
        self.runs[p["runId"]] = {"batch": p["batchId"], "rows": rows, "seconds": p.get("durationMs", {}).get("triggerExecution", 0) / 1000, "rows_a_second": p.get("processedRowsPerSecond", 0.0),
                                 "end": source.get("endOffset"), "batches": before["batches"] + (rows > 0), "all_rows": before["all_rows"] + rows}
        while len(self.runs) > RUNS:
            self.runs.popitem(last=False)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
