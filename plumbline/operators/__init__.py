"""Time-series, cross-section, portfolio and universe operators over long panels."""
