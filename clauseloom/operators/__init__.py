"""DataFrame to DataFrame operators, keyed by ``meeting``.

They are lazy, except where a result is read several times: that is written once to the shared
folder (``session.cut_lineage``), which also keeps plans short and survives the loss of executors.
"""
