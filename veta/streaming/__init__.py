"""Streams.

There are no stream operators: everything statistical here is a batch aggregate.
What was fitted on a batch (recodes, clips, bins, DesignSpec, model scores) is a
plain column expression, so it can be applied to a streaming DataFrame as it is;
``tests/test_streaming.py`` shows it for a fitted model.
"""
