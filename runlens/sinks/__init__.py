"""Writers of the record lake, training tables, feature cache, landed records and topics."""
