"""A file has one timer, for the oldest copy it keeps, however many copies there are."""

import pandas as pd

from chunkloom.streaming.ingest import DAY, Retention


class Handle:
    """State and timers of one key."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Now:
    def __init__(self, day):
        self.at = day * DAY

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_one_timer_for_all_copies_of_a_file():
    h, r = Handle(), Retention(2)
    r.init(h)
    days = lambda frames: [(x - pd.Timestamp(0).date()).days for f in frames for x in f["backed_up"]]
    rows = lambda *d: iter([pd.DataFrame({"day": [x * DAY for x in d]})])
    assert days(r.handleInputRows((1,), rows(12, 10, 14, 10), Now(0))) == [] and h.timers == {13 * DAY}
    assert days(r.handleInputRows((1,), rows(9, 5, 12), Now(8))) == [5] and h.timers == {12 * DAY}
    h.timers.clear()  # a timer that fires is gone
    assert days(r.handleExpiredTimer((1,), Now(13), Now(12))) == [9, 10] and h.timers == {15 * DAY}
    h.timers.clear()
    assert days(r.handleExpiredTimer((1,), Now(30), Now(15))) == [12, 14] and not h.timers and not h.exists()
