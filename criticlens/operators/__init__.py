"""DataFrame operators: cleaning, scoring, time series, negative reviews, correlation, pages."""
