"""Column functions: money, clocks, tickers, fees and the normal distribution."""
