"""Sources and encoders: driver tables, catalogs, JSON codecs, synthetic traffic."""
