"""Column expressions: rigid transforms, cameras, geodesy, NMEA sentences, colours."""
