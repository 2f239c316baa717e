"""Column expressions, designs and numeric kernels."""
