"""Errors that callers may expect; ``code`` is stable and machine-readable."""


class GaugeError(Exception):
    code = "gauge_error"

    def to_dict(self) -> dict[str, str]:
        return {"code": self.code, "message": str(self)}


class DependencyError(GaugeError):
    """A library that a reader needs is not installed."""

    code = "dependency_error"


class InputError(GaugeError):
    """The source cannot be read or is not supported."""

    code = "input_error"


class ProfileError(GaugeError):
    """A profile is unknown or invalid."""

    code = "profile_error"


class AnalysisError(GaugeError):
    """The source was read but could not be measured."""

    code = "analysis_error"


class AdapterError(GaugeError):
    code = "adapter_error"


class AdapterNotFoundError(AdapterError):
    code = "adapter_not_found"


class AdapterContractError(AdapterError):
    """An adapter, its configuration or its output breaks the contract."""

    code = "adapter_contract_error"


class AdapterExecutionError(AdapterError):
    """An adapter failed unexpectedly."""

    code = "adapter_execution_error"
